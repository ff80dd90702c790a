"""Removal of repeated word spans, found by compacting a de Bruijn graph of token k-mers.

An edge of the graph is a window of ``WINDOW`` words, a node the ``WINDOW - 1`` words that two following windows share. Only
edges that occur at least twice are in the graph. They are found as follows, so that not every window is shuffled:

* Each window has an anchor, the least (by a mixed hash, leftmost on ties) of its ``KMER``-word k-mers. A run of windows
  with one anchor is a segment. Equal windows have equal anchors at equal offsets, so nothing that repeats is missed.
* A segment that occurs twice as a whole is a path of repeated edges, kept as one arc. Where an anchor has several
  segments, the path branches, and the windows of those that occur once are arcs of their own.
* Arcs are read again at their source coordinates; only arcs whose words agree in two hashes of unlike kinds (64 bits each,
  over all words) count as repeated.

Then ``paths`` compacts: a node with one arc in and one arc out doesn't branch, and its two arcs are one path. Arcs that
follow each other at their first source coordinates are joined at once; what crosses documents is joined by doubling
pointers, a Spark join each round. At last the occurrences of a path's arcs in a document become long spans, whose
coordinates have to be without a gap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import MASK64, discard, join_salted, materialize, small_batches, table, utf8

WINDOW = 35
KMER = 10

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; a longer word goes through xxhash.
_PIECE = 1 << 20
#: Arcs after which a batch is handed on.
_HELD = 1 << 15


_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end, in bytes."""
    outside = np.ones(1, bool)
    space = np.concatenate([outside, _IS_SPACE[np.frombuffer(data, np.uint8)], outside])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of all spans of a document's words, from running sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16, 2 * len(self.powers))
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE, np.uint64)])

    def words(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word: the same sums over its bytes, which count from 1 as a byte 0 is one as well."""
        raw, out, at = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, low + _PIECE, "right")))
            n = int(ends[to - 1]) - low
            if n > _PIECE:
                out[at] = xxhash.xxh64_intdigest(data[low : low + n])
            else:
                self._grow(n + 1)
                sums = self._sums(raw[low : low + n].astype(np.uint64) + np.uint64(1))
                a = starts[at:to] - low
                out[at:to] = (sums[ends[at:to] - low] - sums[a]) * self.inverses[a]
            at = to
        return _mix(out)

    def _sums(self, each: np.ndarray) -> np.ndarray:
        self._grow(len(each) + 1)
        sums = np.zeros(len(each) + 1, np.uint64)
        np.cumsum(each * self.powers[: len(each)], out=sums[1:])
        return sums

    def sums(self, words: list[bytes] | np.ndarray) -> np.ndarray:
        """Running sums over a document's words or their hashes."""
        if not isinstance(words, np.ndarray):
            data = b" ".join(words)
            words = self.words(data, *cut(data))
        return self._sums(words)

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.inverses[start])


def anchors(hasher: Hasher, words: list[bytes] | np.ndarray, window: int = WINDOW, k: int = KMER):
    """Anchors of a document, given its words or their hashes: hash, context hash, first and last start of the windows each one is the anchor of."""
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = hasher.sums(words)
    at = np.arange(len(words) - k + 1)
    kmers = hasher.spans(sums, at, at + k)
    width = window - k + 1
    low = np.lib.stride_tricks.sliding_window_view(kmers, width)
    place = np.arange(n)
    for i in range(0, n, 65536):
        place[i : i + 65536] += low[i : i + 65536].argmin(axis=1)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], n] - 1
    where = place[first]
    context = hasher.spans(sums, first, last + window)
    shape = ((where - first) * window + (last - first)).astype(np.uint64)
    return kmers[where], _mix(context ^ (shape * np.uint64(_BASE))), first, last


def _hashed(hasher: Hasher, texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, worked out for many short texts at once."""
    part, size = [], 0

    def told() -> Iterator[np.ndarray]:
        data = b" ".join(part)
        starts, ends = cut(data)
        each = hasher.words(data, starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))
        return (each[i:j] for i, j in zip(bounds[:-1], bounds[1:]))

    for t in texts:
        part.append(t.as_py() or b"")
        size += len(part[-1])
        if size >= _PIECE:
            yield from told()
            part, size = [], 0
    if part:
        yield from told()


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        found = [anchors(hasher, words) for words in _hashed(hasher, b["text"])]
        count = np.array([len(f[0]) for f in found], np.int64)
        rows = pa.array(np.repeat(np.arange(len(count)), count))
        h, c, first, last = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"].take(rows), b["text_key"].take(rows), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
            ["doc_id", "text_key", "anchor", "context", "first", "last"],
        )


def read_edges(hasher: Hasher, words: list[bytes], asked: list[np.ndarray]) -> list[np.ndarray]:
    """Arcs of a document, read at its coordinates: two hashes of all its words, first, size, source node, end node, own.

    ``asked`` are segments: first, last, repeated, verify. A repeated one is an arc; the windows of others are. With
    ``verify``, the windows of a repeated one are read too, as partners of others' windows (``own`` is false).
    """
    once = np.unique(asked[0], return_index=True)[1]  # a row that is there twice asks twice
    first, last, repeated, verify = (x[once] for x in asked)
    count = np.where(verify | ~repeated, last - first + 1, 0)
    each = np.repeat(np.arange(len(first)), count)
    inside = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    size = np.r_[(last - first + 1)[repeated], np.ones(len(each), np.int64)]
    at = np.r_[first[repeated], first[each] + inside]
    joined = b" ".join(words)
    starts, ends = cut(joined)
    sums = hasher.sums(hasher.words(joined, starts, ends))
    digest, view = xxhash.xxh3_64_digest, memoryview(joined)
    of = np.frombuffer(b"".join([digest(view[s:e]) for s, e in zip(starts[at].tolist(), ends[at + size + WINDOW - 2].tolist())]), "<u8")
    nodes = (hasher.spans(sums, x, x + WINDOW - 1).view(np.int64) for x in (at, at + size))
    own = np.r_[np.ones(int(repeated.sum()), bool), ~repeated[each]]
    return [hasher.spans(sums, at, at + size + WINDOW - 1).view(np.int64), of.view(np.int64), at, size, *nodes, own]


_EDGES = {"sums": pa.int64(), "words": pa.int64(), "first": pa.int32(), "size": pa.int32(), "source_node": pa.int64(), "end_node": pa.int64(), "own": pa.bool_()}


def _edge_batch(of: list[tuple], found: list[list[np.ndarray]]) -> pa.RecordBatch:
    """The arcs of some documents, given (doc_id, text_key) of each."""
    rows = pa.array(np.repeat(np.arange(len(of)), [len(f[0]) for f in found]))
    keys = [pa.array(k, pa.int64()).take(rows) for k in zip(*of)]
    columns = [pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*found), _EDGES.values())]
    return pa.RecordBatch.from_arrays([*keys, *columns], ["doc_id", "text_key", *_EDGES])


def _find_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    of, found, held = [], [], 0
    for b in batches:
        cuts, asked = b["spans"].offsets.to_numpy(), b["spans"].values
        fields = [asked.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
        for i in range(b.num_rows):
            part = [x[cuts[i] : cuts[i + 1]] for x in fields]
            found.append(read_edges(hasher, (b["text"][i].as_py() or b"").split(), [*(x.astype(np.int64) for x in part[:2]), *part[2:]]))
            of.append((b["doc_id"][i].as_py(), b["text_key"][i].as_py()))
            held += len(found[-1][0])
            if held >= _HELD:
                yield _edge_batch(of, found)
                of, found, held = [], [], 0
    if of:
        yield _edge_batch(of, found)


def _doubled(links: DataFrame) -> DataFrame:
    """``run, top, far``: where the chain of ``links(run, up, dist)`` that each run is on begins, and how far before it.

    Each round doubles the reach of a run's pointer, by one join; a run whose pointer has come to a top is done. What isn't
    done when the pointers reach further than there are runs is on a cycle, which is cut at its least run.
    """
    tops = links.select(F.col("up").alias("run")).join(links.select("run"), "run", "left_anti").distinct()
    state = links.select("run", F.col("up").alias("top"), F.col("dist").alias("far"), F.least("run", "up").alias("low"), F.lit(False).alias("done"))
    state = materialize(state.unionAll(tops.select("run", F.col("run").alias("top"), F.lit(0).cast("long").alias("far"), F.col("run").alias("low"), F.lit(True).alias("done"))), "pointers")
    waiting, rounds = state.where("NOT done").count(), 0
    most = waiting.bit_length() + 1
    while waiting and rounds < most:
        to = state.select(F.col("run").alias("to"), F.col("top").alias("to_top"), F.col("far").alias("to_far"), F.col("low").alias("to_low"), F.col("done").alias("to_done"))
        ahead = state.where("NOT done").join(to, F.col("top") == F.col("to"))
        ahead = ahead.select("run", F.col("to_top").alias("top"), (F.col("far") + F.col("to_far")).alias("far"), F.least("low", "to_low").alias("low"), F.col("to_done").alias("done"))
        state = materialize(state.where("done").unionAll(ahead), "pointers")
        waiting, rounds = state.where("NOT done").count(), rounds + 1
    found = state.where("done").select("run", "top", "far")
    if not waiting:
        return found
    cycles = links.join(state.where("NOT done").select("run", "low"), "run").where("run <> low").select("run", "up", "dist")
    return found.unionAll(_doubled(materialize(cycles, "cycles")))


def paths(arcs: DataFrame) -> DataFrame:
    """``id, path, at`` for each of ``arcs(id, source_node, end_node, size, doc, first)``.

    A path is a longest chain of arcs over nodes that don't branch, named by its first arc; ``at`` is the number of edges
    before the arc in it. A closed chain begins at one of its arcs.
    """
    none = F.lit(None).cast("long")
    ends = arcs.select(F.col("source_node").alias("node"), none.alias("comes"), F.col("id").alias("goes"))
    ends = ends.unionAll(arcs.select(F.col("end_node").alias("node"), F.col("id").alias("comes"), none.alias("goes")))
    plain = ends.groupBy("node").agg(F.count("comes").alias("ins"), F.count("goes").alias("outs"), F.min("comes").alias("up"), F.min("goes").alias("next"))
    plain = plain.where("ins = 1 AND outs = 1 AND up <> next").select("up", "next")

    linked = arcs.join(plain, arcs["id"] == F.col("next"), "left").drop("next")
    order = Window.partitionBy("doc").orderBy("first", "size", "id")
    follows = (F.lag("id").over(order) == F.col("up")) & (F.lag(F.col("first") + F.col("size")).over(order) == F.col("first"))
    linked = linked.withColumn("begins", ~F.coalesce(follows, F.lit(False)))
    head = lambda c: F.last(F.when(F.col("begins"), F.col(c)), ignorenulls=True).over(order)
    runs = linked.select("id", "size", "up", "begins", head("id").alias("run"), (F.col("first") - head("first")).cast("long").alias("inside"))
    runs = materialize(runs, "runs")

    before = runs.select(F.col("id").alias("up"), F.col("run").alias("up_run"), (F.col("inside") + F.col("size")).alias("dist"))
    links = runs.where("begins AND up IS NOT NULL").select("run", "up").join(before, "up").select("run", F.col("up_run").alias("up"), "dist")
    tops = _doubled(materialize(links, "links"))
    return runs.join(tops, "run", "left").select("id", F.coalesce("top", "run").alias("path"), (F.col("inside") + F.coalesce("far", F.lit(0))).alias("at"))


def remove_spans(text: bytes, spans: list[tuple[int, int]], window: int = WINDOW) -> tuple[int, int, bytes]:
    """Words, words removed, and the words left (joined by a space), for spans of window starts (first, last)."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for first, last in spans:
        change[first] += 1
        change[last + window] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join(compress(words, (~gone).tolist()))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [remove_spans(t.as_py() or b"", [(s["first"], s["last"]) for s in spans.as_py() or ()]) for t, spans in zip(b["text"], b["spans"])]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.binary())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their bytes and key, and ``(span_id, span_key, spans)``: where repeated windows start."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), utf8(F.col("text")).alias("text"))
    found = materialize(rows.mapInArrow(_find_anchors, "doc_id long, text_key long, anchor long, context long, first int, last int"), "anchors")

    # One row for each segment, then for each anchor: both are summed before they are dealt out.
    contexts = materialize(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min("doc_id").alias("of")), "contexts")
    branching = contexts.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1").select("anchor", F.lit(True).alias("branches"))
    state = contexts.join(branching, "anchor", "left").where("n > 1 OR branches")
    state = state.select("anchor", "context", (F.col("n") > 1).alias("repeated"), "of", F.coalesce("branches", F.lit(False)).alias("branches"))
    # A repeated segment needs the windows of its first document only, as partners for others.
    verify = F.col("branches") & (~F.col("repeated") | F.col("of").eqNullSafe(F.col("doc_id")))
    placed = found.join(state, ["anchor", "context"]).select("doc_id", "text_key", "first", "last", "repeated", verify.alias("verify"))
    placed = materialize(placed, "placed")
    discard(found)  # all that follows reads the placed segments
    discard(contexts)

    # Source coordinates: the arcs, read from the text again.
    ask = placed.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last", "repeated", "verify")).alias("spans"))
    ask = ask.select(F.col("doc_id").alias("ask_id"), F.col("text_key").alias("ask_key"), "spans")
    asked = rows.join(ask, rows["doc_id"].eqNullSafe(F.col("ask_id")) & (rows["text_key"] == F.col("ask_key")))
    kinds = "doc_id long, text_key long, sums long, words long, first int, size int, source_node long, end_node long, own boolean"
    edges = materialize(asked.select("doc_id", "text_key", "text", "spans").mapInArrow(_find_edges, kinds), "edges")
    discard(placed)
    # A first source coordinate as one number, so that the sums stay in a hash table: 40 bits for the document, 24 for the place.
    source = F.shiftleft(F.xxhash64("doc_id", "text_key"), 24).bitwiseOR(F.col("first").cast("long"))
    same = ["sums", "words", "size"]
    arcs = edges.groupBy(*same).agg(F.count("*").alias("n"), F.max("own").alias("own"), F.min("source_node").alias("source_node"), F.min("end_node").alias("end_node"), F.min(source).alias("source"))
    place = (F.shiftright("source", 24).alias("doc"), F.col("source").bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("first"))
    arcs = materialize(arcs.where("n > 1 AND own").select(F.xxhash64(*same).alias("id"), *same, "n", "source_node", "end_node", *place), "arcs")

    keyed = materialize(arcs.select("id", *same, "n").join(paths(arcs), "id").drop("id"), "paths")
    here = join_salted(edges.where("own").select("doc_id", "text_key", "first", *same), keyed, same)
    here = here.select("doc_id", "text_key", "path", (F.col("first") - F.col("at")).alias("origin"), "first", (F.col("first") + F.col("size") - 1).alias("last"))
    here = materialize(here, "here")
    discard(edges)
    key = ["doc_id", "text_key", "path", "origin"]
    whole = here.groupBy(*key).agg(F.min("first").alias("low"), F.max("last").alias("high"), F.sum(F.col("last") - F.col("first") + 1).alias("n"))
    whole = materialize(whole, "whole")
    no_gap = F.col("n") == F.col("high") - F.col("low") + 1
    spans = whole.where(no_gap).select("doc_id", "text_key", F.col("low").alias("first"), F.col("high").alias("last"))
    # Parts with a gap between them, or of a row that is there twice, stay as they are.
    apart = whole.where(~no_gap).select(*(F.col(c).alias(f"apart_{c}") for c in key))
    parts = here.join(apart, F.expr(" AND ".join(f"{c} <=> apart_{c}" for c in key)), "left_semi").select("doc_id", "text_key", "first", "last")
    spans = spans.unionAll(parts.distinct()).groupBy(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key")).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return rows, spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept (binary)`` for each row of ``docs(doc_id, text)``.

    A word goes when a window of 35 words over it begins anywhere else as well, in the same document or
    another; windows are judged on the input. Words are cut at ASCII white space and otherwise unchanged.
    Null and empty texts have no words and keep an empty text. A row that repeats another counts as another
    document. Texts of fewer than 35 words lose nothing. An empty table gives an empty result; columns
    other than the two are not read.
    """
    small_batches(docs.sparkSession)
    rows, spans = repeated_spans(docs)
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(F.col("span_id")) & (rows["text_key"] == F.col("span_key")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_rewrite, "doc_id long, n_words long, n_removed long, kept binary")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM w),
s AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS span FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY span) AS n FROM s WHERE i <= n - {WINDOW - 1}) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (SELECT unnest(generate_series(0, {WINDOW - 1})) AS o)),
k AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

assert _BASE * _INVERSE & MASK64 == 1
