"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed by Spark into a table of at most ``len(languages) * BUCKETS`` rows, so the matrix of log
probabilities that goes to every executor has a fixed bound (``MOST_LANGUAGES * BUCKETS * 8`` bytes). Texts are scored
a batch at a time in numpy: one gather for each n-gram length, then sums between document borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import fresh, held, materialize, small_batches, table

BUCKETS = 1 << 14
LENGTHS = (1, 2, 3)
#: Documents the model is fitted on at most (about; a hashed share of the labelled ones). Prediction has no bound.
FIT_ROWS = 20_000
#: Languages of a model at most: those with most documents. Further label values aren't learned, as a model is told to all tasks.
MOST_LANGUAGES = 512
#: Languages whose counts a task holds at a time.
COUNTED = 256
UNKNOWN = "und"
#: Characters handled at once; longer texts go in pieces that overlap by the longest n-gram less one.
PIECE = 1 << 20

#: Matrix entries gathered at once, and pieces of n-grams that wait for it.
GATHERED, HELD = 1 << 20, 96

_LETTER = regex.compile(r"\p{L}")
_DIGIT = regex.compile(r"[^\p{L}\p{M}]+")


def prepared(text: str) -> str:
    """Lower case; whatever isn't a letter or a mark becomes one space."""
    return f" {_DIGIT.sub(' ', text.lower()).strip()} "


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a prepared text, piece by piece."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), PIECE):
        for n in LENGTHS:
            part = points[at : at + PIECE + n - 1].astype(np.uint64)
            if len(part) < n:
                continue
            h = np.zeros(len(part) - n + 1, np.uint64) + np.uint64(n)
            for i in range(n):
                h = (h + part[i : len(part) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, row in totals.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(row[used])], ["lang", "bucket", "n"])
        totals.clear()

    for b in batches:
        for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist()):
            if not text or not _LETTER.search(text):
                continue
            if lang not in totals:
                if len(totals) >= COUNTED:
                    yield from told()
                totals[lang] = np.zeros(BUCKETS + 1, np.int64)
            row = totals[lang]
            row[BUCKETS] += 1
            for g in grams(prepared(text)):
                row[:BUCKETS] += np.bincount(g, minlength=BUCKETS)
    yield from told()


class Model:
    """Languages in order and the matrix of log probabilities, a row for each bucket and a column for each language."""

    def __init__(self, languages: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.languages, self.prior, self.matrix = languages, prior, matrix

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language and its probability; ``und`` and 0 for a text without letters."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        total = np.tile(self.prior, (len(texts), 1))
        read, held, most = np.zeros(len(texts), bool), [], max(BUCKETS, GATHERED // len(self.languages))
        for i, text in enumerate(texts):
            if not text or not _LETTER.search(text):
                continue
            read[i] = True
            for g in grams(prepared(text)):
                if len(g) > BUCKETS:
                    total[i] += np.bincount(g, minlength=BUCKETS) @ self.matrix
                else:
                    held.append((i, g))
            if len(held) > HELD:
                self._add(total, held, most)
                held = []
        self._add(total, held, most)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        for i in np.flatnonzero(read).tolist():
            names[i], scores[i] = self.languages[best[i]], float(share[i])
        return names, scores

    def _add(self, total: np.ndarray, held: list[tuple[int, np.ndarray]], most: int) -> None:
        """Add the gathered rows of all held n-grams to their documents, at most ``most`` (or one piece) at once."""
        at = 0
        while at < len(held):
            end, size = at, 0
            while end < len(held) and (end == at or size + len(held[end][1]) <= most):
                size += len(held[end][1])
                end += 1
            part, at = held[at:end], end
            starts = np.cumsum([0, *(len(g) for _, g in part[:-1])])
            sums = np.add.reduceat(self.matrix[np.concatenate([g for _, g in part])], starts, axis=0)
            np.add.at(total, [i for i, _ in part], sums)


def is_held_out(doc_id: Column) -> Column:
    """Documents never learned from: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from ``text`` and ``lang`` of the labelled documents that aren't held out.

    About ``fit_rows`` of them are read, chosen by a hash of the id, so the model depends on the table alone. Rows with
    a null id, text or label and texts without letters teach nothing; without any usable row the model predicts ``und``.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    share = min(1.0, fit_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)))
    counted = chosen.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(_count, "lang string, bucket int, n long")
    counted = materialize(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    kept = counted.where(F.col("bucket") == BUCKETS).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select("lang")
    rows = counted.join(F.broadcast(kept), "lang").orderBy("lang", "bucket").toArrow()  # at most MOST_LANGUAGES * (BUCKETS + 1)
    names = sorted(set(rows["lang"].to_pylist()))
    table_ = np.zeros((len(names), BUCKETS + 1))
    if len(names):
        table_[np.searchsorted(names, rows["lang"].to_pylist()), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    counts, documents = table_[:, :BUCKETS] + 0.5, table_[:, BUCKETS]
    matrix = np.log(counts / counts.sum(axis=1, keepdims=True)) if len(names) else counts
    prior = np.log(documents / documents.sum()) if len(names) else documents
    return Model(names, prior, np.ascontiguousarray(matrix.T))


def predict(docs: DataFrame, model: Model, into: str = "lang_found") -> DataFrame:
    """``docs`` with a struct column ``into`` of ``name`` and ``score``; no other column is changed or lost."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES * BUCKETS floats

    @F.arrow_udf(T.StructType().add("name", T.StringType()).add("score", T.DoubleType()))
    def found(texts: pa.Array) -> pa.Array:
        held("language")
        names, scores = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["name", "score"])

    return docs.withColumn(into, found(F.col("text").cast("string")))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs(doc_id, text, lang)``.

    A prediction reads the text alone. ``und`` with score 0 stands for a null or empty text, or one without letters.
    Null ids aren't held out and aren't learned from; repeated rows stay repeated; other columns aren't read; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text", "lang")
    scored = predict(own.select("doc_id", "text"), fit(own))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("lang_found.name").alias("lang_pred"), F.col("lang_found.score").alias("score"))


def accepted(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents whose language is found with at least this probability, all columns kept."""
    small_batches(docs.sparkSession)
    into = fresh(docs, "lang_found")
    scored = predict(docs, fit(docs.select("doc_id", "text", "lang")), into)
    return scored.where((F.col(into)["name"] != UNKNOWN) & (F.col(into)["score"] >= least)).drop(into)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
