"""Payloads kept as sound: 8-bit WAV through the wave module, short-time Fourier transforms, and fingerprints
of pairs of spectral peaks as time-coded arrays."""

from __future__ import annotations

import hashlib
import io
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import small_batches, table, utf8

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    import wave

#: Payloads are padded with bytes 255 to a positive multiple of this.
UNIT = 576
TAIL = 32
RATE = 8000

FRAME, HOP = 256, 192
#: Bands of the spectrum (bin borders) in each of which the strongest bin may be a peak.
BANDS = (2, 8, 20, 48, 96, 129)
#: A peak stands out from its frame's mean magnitude by this factor.
STANDS_OUT = 2.0
#: Peaks pair with those of up to so many later frames, and with the nearest so many.
REACH, PARTNERS = 8, 3
#: Frames transformed at once; memory for a long payload follows from it.
FRAMES = 4096


def padded(data: bytes) -> bytes:
    missing = -len(data) % UNIT if data else UNIT
    return data + b"\xff" * missing


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of each spectral peak, by frame, then bin.

    Silence follows the samples for the transform, so that a last frame covers their end. The stored payload has none of it.
    """
    samples = np.frombuffer(payload, np.uint8)
    n = 1 + -(-max(0, len(samples) - FRAME) // HOP)
    samples = np.concatenate([samples, np.full((n - 1) * HOP + FRAME - len(samples), 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    times, bins = [], []
    for at in range(0, n, FRAMES):
        part = (frames[at : at + FRAMES].astype(np.float32) - 128) * window
        loud = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)
        least = STANDS_OUT * loud.mean(axis=1)
        best = np.stack([lo + loud[:, lo:hi].argmax(axis=1) for lo, hi in zip(BANDS, BANDS[1:])], axis=1)
        out = np.take_along_axis(loud, best, axis=1) > least[:, None]
        row, column = np.nonzero(out)
        times.append(row + at)
        bins.append(best[row, column])
    return np.concatenate(times), np.concatenate(bins)


def pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints ``bin | bin of the partner | frames between`` (8, 8 and 4 bits) and the frame of each."""
    code, when = [], []
    for step in range(1, PARTNERS + 1):
        a = np.arange(max(0, len(times) - step))
        gap = times[a + step] - times[a]
        a = a[gap <= REACH]
        code.append(bins[a] << 12 | bins[a + step] << 4 | (times[a + step] - times[a]))
        when.append(times[a])
    code, when = np.concatenate(code), np.concatenate(when)
    order = np.lexsort((code, when))
    return code[order].astype(np.int32), when[order].astype(np.int32)


_MADE = (
    T.StructType().add("n_bytes", T.LongType()).add("payload_bytes", T.LongType()).add("payload_sha256", T.StringType()).add("tail_crc32", T.LongType())
    .add("media_bytes", T.LongType()).add("media_sha256", T.StringType()).add("times", T.ArrayType(T.IntegerType())).add("prints", T.ArrayType(T.IntegerType()))
)
_MEDIA = T.StructType([*_MADE.fields, T.StructField("media", T.BinaryType())])


def _make(texts: pa.Array, keep: bool) -> pa.Array:
    rows = []
    for t in texts:
        data = t.as_py() or b""
        media = to_wav(padded(data))
        payload = from_wav(media)
        prints, times = pairs(*peaks(payload))
        rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), times, prints, media if keep else None))
    columns = list(zip(*rows)) if rows else [()] * 9
    arrays = [pa.array(columns[i], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
    for i in (6, 7):
        flat = np.concatenate([np.zeros(0, np.int32), *columns[i]])
        arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, columns[i])]).astype(np.int32)), pa.array(flat)))
    if keep:
        arrays.append(pa.array(columns[8], pa.binary()))
    return pa.StructArray.from_arrays(arrays, [f.name for f in (_MEDIA if keep else _MADE).fields])


@F.arrow_udf(_MADE)
def _features(texts: pa.Array) -> pa.Array:
    return _make(texts, False)


@F.arrow_udf(_MEDIA)
def _media(texts: pa.Array) -> pa.Array:
    return _make(texts, True)


def fingerprints(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """``doc_id``, sizes and digests of payload and media, and the arrays ``times`` and ``prints``, for each row.

    A null text counts as empty, and its payload is one unit of bytes 255. The payload digests are of what the wave
    module read back. Equal texts have equal values; repeated rows stay repeated; other columns aren't read; an
    empty table gives an empty result. ``keep_media`` adds the stored bytes as ``media``.
    """
    small_batches(docs.sparkSession)
    made = _media if keep_media else _features
    return docs.select("doc_id", made(utf8(F.col("text"))).alias("made")).select("doc_id", "made.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"))
    coded = F.transform(F.arrays_zip("times", "prints"), lambda p: F.concat_ws(":", p["times"].cast("string"), p["prints"].cast("string")))
    feature = F.array_join(coded, ",")  # every print with its time, none left out
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
