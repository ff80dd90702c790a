"""SimHash fingerprints and their near-duplicate classes, found with a Gray-order hierarchical index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import join_salted, materialize, small_batches, table, utf8
from .components import components
from .gray import near_links

SEED = 42
SHINGLE = 4
MOST_BITS = 4


def fingerprint(text: bytes) -> bytes:
    """The 64-bit SimHash of one text as 8 bytes, highest bit first.

    Words are cut at ASCII white space after A-Z are lower-cased; shingles are 4 words, repeats
    included; a text of fewer words is one shingle, one without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    ends = (ends - 1)[SHINGLE - 1 :].tolist()
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        part = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        # 255 rows at a time fit byte sums, which numpy adds several at once
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


@F.arrow_udf(T.LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    joined = b"".join(fingerprint(t.as_py() or b"") for t in texts)
    return pa.array(np.frombuffer(joined, ">i8").astype(np.int64))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """One row per input row: ``doc_id, fp (long), component_id``, the smallest id reachable over links.

    Two documents link when their fingerprints differ in at most ``most`` bits. Null and empty texts
    have fingerprint zero and link like any other. Repeated rows stay repeated. Null ids are allowed;
    a class of null ids alone has a null component. Other columns are not read. An empty table gives
    an empty result.
    """
    small_batches(docs.sparkSession)
    prints = docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(utf8(F.col(text_col))).alias("fp"))
    prints = materialize(prints, "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct")
    root = components(near_links(distinct.select("fp"), most)).withColumnRenamed("node", "rooted")
    labelled = distinct.join(root, distinct["fp"] == F.col("rooted"), "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("members"))
    classes = labelled.join(least, "root").select("fp", "n", "component_id")
    return join_salted(prints, classes, ["fp"]).select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
