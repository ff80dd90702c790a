"""Connected components over an edge table: within tasks first, then by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, materialize
from .gray import roots

#: Edges that a task joins at once. What is no more than this after that needs no rounds: one task ends it.
TASK_EDGES = 1 << 18


def _joined(most: int, whole: bool) -> Callable:
    """For each ``most`` edges or so, an edge from each of their nodes to the smallest it reaches over them; with ``whole``, from that to itself as well."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("u", "v"))
        nodes, at = np.unique(np.r_[u, v], return_inverse=True)
        root = nodes[roots(np.arange(len(nodes)), at[: len(u)], at[len(u) :])]
        keep = slice(None) if whole else nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= most and not whole:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return run


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Label each node of ``edges(u, v)`` with the smallest node it can reach: ``(node, root)``.

    Nodes without an edge don't appear. Each task first puts the stars of what its edges connect in their place, which
    can't be more. If at most ``TASK_EDGES`` are left, one task joins them: a round costs the driver some ten exchanges
    with a task for each partition, however small the table is. Else there are rounds. Each round replaces a node's edges by edges to its smallest
    neighbour, so the number of rounds grows with the logarithm of the longest path. A round is two
    aggregations (with partial sums, so a hub is no hot key) and two joins that Spark may split.
    Each round is cut by a written table. Empty input gives an empty result; self-loops and repeated
    edges are ignored.
    """
    now = materialize(edges.where("u <> v").select("u", "v").mapInArrow(_joined(TASK_EDGES, False), "u long, v long"), "edges")
    before = _state(now)
    if before[0] <= TASK_EDGES:
        labels = materialize(now.coalesce(1).mapInArrow(_joined(TASK_EDGES, True), "u long, v long").toDF("node", "root"), "labels")
        discard(now)
        return labels
    while before[0]:
        # Large star: every larger neighbour of a node moves to the smallest of its neighbourhood.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: the smaller neighbours of a node, and the node itself, move to the smallest of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionAll(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
