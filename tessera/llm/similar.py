"""Near copies by word shingles: classes of documents that have most of their shingles in common.

A 64-bit SimHash tells copies within a few bits, and the Gray-order index finds all of those. Documents with four fifths of
their 5-word shingles in common lie about 10 bits apart, out of reach of any index by bits; so candidates are the index's
links and, besides, documents that share one of ``BANDS`` min-hash bands and have SimHashes within ``RADIUS`` bits. Every
candidate is decided by the shingles themselves, read from the text again.

A group of near copies isn't expanded into its pairs. Its members are first held against a pivot, the member that shares
most bands with others, which is the original the copies were made of if that is there. Groups that still have several
classes are settled in tasks: the members outside the largest class are an inverted index over their shingles, and all
members of the group stream past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import discard, fresh, held, join_salted, materialize, small_batches, utf8
from .components import components
from .gray import near_links

SEED = 42
#: Words of a shingle, and the per cent of all shingles of two documents that both have.
SHINGLE, PERCENT = 5, 80
#: Min-hash bands, and least hashes in each. A pair with four fifths in common shares no band once in 14,000 times.
BANDS, BAND_ROWS = 24, 5
#: SimHashes of such a pair differ in 10 of 64 bits (12 for shortest texts), with deviation 3; more than this isn't tried.
RADIUS = 26
#: Bits within which the index gives candidates.
LINKED_BITS = 4
#: Rounds in which each unsettled group has a pivot.
PIVOTS = 2
#: Bytes of shingles of the members that a task indexes.
ASK_BYTES = 32 << 20
#: Bytes of an Arrow batch: texts, sets of shingles and pairs of those. Each task holds a few on either side of its worker.
BATCH_BYTES = 4 << 20


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; words and short texts as in ``simhash.fingerprint``."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, size=(3, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each min-hash band; keys of different bands differ."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 10):
        least = np.minimum(least, ((hashes[at : at + (1 << 10), None] ^ _DRAWN[0]) * _DRAWN[1]).min(axis=0))
    least ^= least >> np.uint64(29)
    return (least * _DRAWN[2]).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two ascending sets have so many per cent of their union in common."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


_SKETCH = T.StructType().add("node", T.LongType()).add("fp", T.LongType()).add("bands", T.ArrayType(T.LongType()))


def _sketch_udf(shingle: int):
    @F.arrow_udf(_SKETCH)
    def run(texts: pa.Array) -> pa.Array:
        held("similar")
        node, fp, keys = [], [], []
        for t in texts:
            hashes = shingle_set(t.as_py() or b"", shingle)
            node.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63))
            fp.append(set_fingerprint(hashes))
            keys.append(bands(hashes))
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * BANDS), flat)
        return pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(fp, pa.int64()), keys], _SKETCH.names)

    return run


def _shingles_udf(shingle: int):
    @F.arrow_udf(T.BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        held("similar")
        return pa.array([shingle_set(t.as_py() or b"", shingle).tobytes() for t in texts], pa.binary())

    return run


def _alike_udf(percent: int):
    @F.arrow_udf(T.BooleanType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        held("similar")
        sets = lambda x: (np.frombuffer(v.as_py(), np.uint64) for v in x)
        return pa.array([alike(u, v, percent) for u, v in zip(sets(a), sets(b))], pa.bool_())

    return run


class Asked:
    """An inverted index over the shingles of some members of a group, with their classes."""

    def __init__(self, node: np.ndarray, fp: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int):
        self.node, self.fp, self.label, self.percent = node, fp, label.copy(), percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.shingle, first = np.unique(every[order], return_index=True)
        self.first = np.r_[first, len(every)]
        self.now: dict[int, int] = {}

    def links(self, node: int, fp: int, label: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Links to members that are alike and of another class, one for each class."""
        while label in self.now:
            label = self.now[label]
        near = np.flatnonzero((self.label != label) & (np.bitwise_count(self.fp ^ np.int64(fp)) <= RADIUS))
        if not len(near):
            return []
        at = np.minimum(np.searchsorted(self.shingle, hashes), len(self.shingle) - 1) if len(self.shingle) else np.zeros(0, np.int64)
        at = at[self.shingle[at] == hashes] if len(at) else at
        size = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(at) else at
        both = np.bincount(self.owner[place], minlength=len(self.node))[near]
        found = []
        for i in near[100 * both >= self.percent * (self.sizes[near] + len(hashes) - both)].tolist():
            other = int(self.label[i])
            if other != label:
                found.append((node, int(self.node[i])))
                self.now[other] = label
                self.label[self.label == other] = label
        return found


def _settle(percent: int) -> Callable:
    """Answer partitions sorted by group, slice and kind: members that ask (kind 0), then all members (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("similar")
        at, asks, index = None, [], None
        for b in batches:
            links = []
            numbers = zip(*(b[c].to_pylist() for c in ("grp", "slice", "kind", "node", "fp", "label")))
            for i, (grp, piece, kind, node, fp, label) in enumerate(numbers):
                if (grp, piece) != at:
                    at, asks, index = (grp, piece), [], None
                hashes = np.frombuffer(b["shingles"][i].as_py(), np.uint64)
                if kind == 0:
                    asks.append((node, fp, label, hashes))
                    continue
                if index is None:
                    index = Asked(*(np.array([a[k] for a in asks], np.int64) for k in range(3)), [a[3] for a in asks], percent)
                links += index.links(node, fp, label, hashes)
            u, v = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of the groups that have several classes, with their class ``label``."""
    root = components(edges).withColumnRenamed("node", "rooted")
    now = members.join(root, members["node"] == F.col("rooted"), "left").withColumn("label", F.coalesce("root", "node")).drop("rooted", "root")
    several = now.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("grp")
    return materialize(now.join(several, "grp", "left_semi"), "unsettled")


def _edges(members: DataFrame, linked: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links ``(u, v)`` that join all nodes that are alike and share a group of ``members(grp, node, fp, weight)``, and ``linked`` ones."""

    def checked(pairs: DataFrame) -> DataFrame:
        a = shingles.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
        b = shingles.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
        return pairs.distinct().join(a, "u").join(b, "v").where(_alike_udf(percent)("a", "b")).select("u", "v")

    edges, now = None, members.withColumn("label", F.col("node"))
    for turn in range(PIVOTS):
        tops = now.groupBy("grp").agg(F.max(F.struct("weight", "node", "fp", "label")).alias("pivot"))
        if turn:  # of those outside the class of the first pivot, so that another class gets its turn
            main = tops.select("grp", F.col("pivot.label").alias("main"))
            tops = now.join(main, "grp").where("label <> main").groupBy("grp").agg(F.max(F.struct("weight", "node", "fp", "label")).alias("pivot"))
        held = now.join(tops, "grp").where((F.col("label") != F.col("pivot.label")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot.fp"))) <= RADIUS))
        pairs = held.select(F.least("node", "pivot.node").alias("u"), F.greatest("node", "pivot.node").alias("v"))
        new = checked(pairs if turn else pairs.unionAll(linked))
        done = [edges, now] if turn else []
        edges = materialize(edges.unionAll(new) if turn else new, "alike")
        now = _labelled(members, edges)
        for table in done:
            discard(table)

    sized = now.join(shingles, "node").withColumn("bytes", F.octet_length("shingles"))
    count = now.groupBy("grp", "label").agg(F.count("*").alias("n"))
    largest = count.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("top")).select("grp", F.col("top.label").alias("main"))
    asks = materialize(sized.join(largest, "grp").where("label <> main").drop("main"), "asks")
    slices = asks.groupBy("grp").agg(F.ceil(F.sum("bytes") / F.lit(ASK_BYTES)).cast("int").alias("slices")).withColumn("slices", F.greatest("slices", F.lit(1)))
    columns = ["grp", "slice", "kind", "node", "fp", "label", "shingles"]
    asking = asks.join(slices, "grp").select("*", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice"), F.lit(0).alias("kind"))
    passing = sized.join(slices, "grp").select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("kind"))
    dealt = asking.select(columns).unionAll(passing.select(columns))
    dealt = dealt.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "slice")
    settled = dealt.sortWithinPartitions("grp", "slice", "kind").mapInArrow(_settle(percent), "u long, v long")
    return materialize(edges.unionAll(settled.distinct()), "alike")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, component_id`` for each row: the smallest id reachable over pairs with ``percent`` of their shingles in common.

    Null and empty texts have no shingles and are alike. Repeated rows stay repeated. Null ids are allowed; a class of null
    ids alone has a null component. Other columns are not read. An empty table gives an empty result. Candidates are those
    of the module's first lines; no group's pairs are listed, no member is left out.
    """
    small_batches(docs.sparkSession, BATCH_BYTES)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), utf8(F.col(text_col)).alias("text"))
    read = materialize(rows.select("doc_id", "text_key", _sketch_udf(shingle)("text").alias("made")).select("doc_id", "text_key", "made.*"), "sketches")
    source = F.min(F.struct("text_key", "doc_id"))
    nodes = read.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"), source.alias("source"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")

    each = nodes.select("node", "fp", F.explode("bands").alias("grp"))
    size = each.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1")
    sized = materialize(each.join(size, "grp"), "members")
    members = materialize(sized.join(sized.groupBy("node").agg(F.sum("size").alias("weight")), "node").drop("size"), "weighed")
    discard(sized)

    of = materialize(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "prints")  # read eight times
    links = near_links(of.select("fp"), LINKED_BITS)
    far = links.join(of.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(of.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    same = nodes.join(of.where("n > 1").select("fp", F.col("node").alias("first")), "fp").where("node > first")
    linked = far.select("a", "b").unionAll(same.select("first", "node")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    linked = materialize(linked, "linked")

    wanted = members.select("node").unionAll(linked.select("u")).unionAll(linked.select("v")).distinct()
    ask = nodes.join(wanted, "node", "left_semi").select("node", F.col("source.text_key").alias("ask_key"), F.col("source.doc_id").alias("ask_id"))
    found = rows.join(ask, (rows["text_key"] == F.col("ask_key")) & rows["doc_id"].eqNullSafe(F.col("ask_id"))).dropDuplicates(["node"])
    shingles = materialize(found.select("node", _shingles_udf(shingle)("text").alias("shingles")), "shingles")

    root = components(_edges(members, linked, shingles, percent)).withColumnRenamed("node", "rooted")
    labelled = nodes.select("node", "n", "least_id").join(root, nodes["node"] == F.col("rooted"), "left").select("node", "n", "least_id", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialize(labelled.join(least, "root").select("node", "n", "component_id"), "classes")  # read three times
    return join_salted(read.select("doc_id", "node"), classes, ["node"]).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents of which ``doc_id`` is the smallest of its class of ``similar`` ones, all columns kept.

    Rows that repeat a kept id stay, as they are one document. Rows without an id stay.
    """
    classes, key = similar(docs, shingle=shingle, percent=percent), fresh(docs, "gone_id")
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(key), "left_anti")
