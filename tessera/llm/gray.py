"""A hierarchical index over fingerprints in Gray order, dealt over the cluster.

Fingerprints are sorted by their rank in the Gray sequence, where neighbours share long bit patterns. A run of that order
is a node: its mask has the bits on which all of the run agree, its pattern their values. Runs of ``FAN_OUT`` nodes are the
nodes above, up to one root. Bits that an upper node's mask has are factored out of those below, so a query's differences
accumulate on the way down, and a whole group is pruned as soon as they exceed the threshold.

The order is kept twice: as the bits stand, and with the halves exchanged. Of two fingerprints within ``most`` bits, either
the upper halves differ in at most ``most // 2`` or the lower ones in fewer than ``most - most // 2``; so each index is
searched with that tighter bound on its leading half, which prunes far higher up, and no link is lost.

On the cluster the order is cut into parts at approximate quantiles. The upper nodes stand for whole parts; they are few
(``MOST_PARTS`` for each order) and known to every task, which sends each query down them to the parts that may hold a
neighbour. A part's members are an index in a task's memory; its queries come as a stream, in as many slices as they need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, materialize

#: Nodes below a node.
FAN_OUT = 16
#: Pairs of a query and a node that are compared at once.
HELD = 1 << 18
#: Members of a part, as long as there are no more than ``MOST_PARTS`` parts in an order; larger tables have larger parts.
PART_ROWS, MOST_PARTS = 1 << 14, 1 << 16
#: Queries of a part that one task answers.
QUERIES = 1 << 16

#: The half of the bits that comes first in an order.
LEADING = np.uint64(0xFFFFFFFF00000000)
_ORDERS = 2


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray sequence: neighbours there differ in few bits."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def turned(fp: np.ndarray, order: int) -> np.ndarray:
    """Fingerprints as an order sees them: as they are, or with their halves exchanged. Its own inverse."""
    return fp << np.uint64(32) | fp >> np.uint64(32) if order else fp


def leading_bits(most: int, order: int) -> int:
    """Bits in which the leading halves of a pair may differ for an order to be asked for it."""
    return most // 2 if order == 0 else most - most // 2 - 1


def roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` after the classes of each pair (a, b) are joined; a class is labelled by its smallest index."""
    label = label.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


class Tree:
    """The hierarchy over units in Gray order; a unit is one fingerprint, or a part with what its members share.

    ``both`` and ``some`` are the AND and the OR of what a unit holds.
    """

    def __init__(self, both: np.ndarray, some: np.ndarray):
        self.pattern, self.mask = [both], [~(both ^ some)]
        while len(both) > 1:
            cuts = np.arange(0, len(both), FAN_OUT)
            both, some = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(some, cuts)
            self.pattern.append(both)
            self.mask.append(~(both ^ some))
        for k in range(len(self.mask) - 1):
            self.mask[k] = self.mask[k] & ~np.repeat(self.mask[k + 1], FAN_OUT)[: len(self.mask[k])]

    def descend(self, queries: np.ndarray, most: int, lead: int, pruned: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, unit) for all units within ``most`` bits, ``lead`` of them leading, on what the unit's members share.

        ``pruned(level, query, node)`` tells what else needn't be looked at. What waits is on a stack of pieces and
        never exceeds a few times ``HELD`` pairs, whatever matches.
        """
        if not len(queries) or not len(self.pattern[0]):
            return
        zero = np.zeros(len(queries), np.uint8)
        stack = [(len(self.pattern) - 1, np.arange(len(queries)), np.zeros(len(queries), np.int64), zero, zero)]
        while stack:
            k, q, node, far, ahead = stack.pop()
            if len(q) > HELD // FAN_OUT:
                half = len(q) // 2
                stack += [(k, *(x[half:] for x in (q, node, far, ahead))), (k, *(x[:half] for x in (q, node, far, ahead)))]
                continue
            differ = (queries[q] ^ self.pattern[k][node]) & self.mask[k][node]
            far, ahead = far + np.bitwise_count(differ), ahead + np.bitwise_count(differ & LEADING)
            keep = np.flatnonzero((far <= most) & (ahead <= lead))
            keep = keep[~pruned(k, q[keep], node[keep])]
            if not len(keep):
                continue
            if k == 0:
                yield q[keep], node[keep]
                continue
            child = (node[keep, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            keep = np.repeat(keep, FAN_OUT)
            real = child < len(self.pattern[k - 1])
            keep = keep[real]
            stack.append((k - 1, q[keep], child[real], far[keep], ahead[keep]))


class Part:
    """The members of a part and the classes that links have joined so far."""

    def __init__(self, members: np.ndarray, most: int, lead: int):
        rank = gray_rank(members)
        order = np.argsort(rank)
        self.fp, self.rank = members[order], rank[order]
        self.tree, self.most, self.lead = Tree(self.fp, self.fp), most, lead
        self.label = np.arange(len(self.fp))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Links between members that follow each other in the order: a dense class forms before it is searched."""
        near = np.flatnonzero(np.bitwise_count(self.fp[1:] ^ self.fp[:-1]) <= self.most)
        return self._joined(roots(self.label, near, near + 1))

    def _joined(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take the new labels of members; the links that say the same."""
        n = len(self.fp)
        gone = np.flatnonzero((self.label == np.arange(n)) & (label[:n] != np.arange(n)))
        self.label = label[:n]
        return self.fp[gone], self.fp[label[gone]]

    def links(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that join each query with all members within ``most`` bits, one for each class at most.

        A query that is a member itself meets only those after it. Runs that lie wholly in the query's class are pruned.
        """
        n = len(self.fp)
        own = np.minimum(np.searchsorted(self.rank, gray_rank(queries)), n - 1)
        own = np.where(self.fp[own] == queries, own, -1)
        label = np.r_[self.label, np.where(own >= 0, self.label[own], n + np.arange(len(queries)))]
        low, high = [label[:n]], [label[:n]]
        for _ in self.tree.pattern[1:]:
            cuts = np.arange(0, len(low[-1]), FAN_OUT)
            low.append(np.minimum.reduceat(low[-1], cuts))
            high.append(np.maximum.reduceat(high[-1], cuts))

        def pruned(k: int, q: np.ndarray, node: np.ndarray) -> np.ndarray:
            of = label[n + q]
            return (low[k][node] == of) & (high[k][node] == of) | ((node + 1) * FAN_OUT**k - 1 <= own[q])

        for q, member in self.tree.descend(queries, self.most, self.lead, pruned):
            apart = label[n + q] != label[member]
            if apart.any():
                label = roots(label, n + q[apart], member[apart])
        new = np.flatnonzero((own < 0) & (label[n:] != n + np.arange(len(queries))))
        a, b = queries[new], self.fp[label[n + new]]
        c, d = self._joined(label)
        return np.r_[a, c], np.r_[b, d]


def _placed(cuts) -> Callable:
    """Each fingerprint with its part in each order; parts of the second order are numbered after those of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for order in range(_ORDERS):
                x = turned(fp, order)
                part = np.searchsorted(cuts.value[order], gray_rank(x), side="right") + order * (len(cuts.value[0]) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(x.view(np.int64))], ["part", "x"])

    return run


def _routed(cuts, upper, most: int) -> Callable:
    """Each fingerprint with the parts, from its own on, that may hold a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(both, some) for both, some in upper.value]
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for order, tree in enumerate(trees):
                x = turned(fp, order)
                own = np.searchsorted(cuts.value[order], gray_rank(x), side="right")
                before = lambda k, q, node, own=own: (node + 1) * FAN_OUT**k - 1 < own[q]
                for q, part in tree.descend(x, most, leading_bits(most, order), before):
                    number = (part + order * (len(cuts.value[0]) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(x[q].view(np.int64))], ["part", "x"])

    return run


def _search(first_of_second: int, most: int) -> Callable:
    """Answer partitions sorted by part, slice and kind: the members of a part (kind 0), then its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            u, v = (pa.array(turned(x, order).view(np.int64)) for x in links)
            return pa.RecordBatch.from_arrays([u, v], ["u", "v"])

        at, members, part, order = None, [], None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b[c].to_numpy().astype(np.int64) for c in ("part", "slice", "kind")])
            x = b["x"].to_numpy().view(np.uint64)
            first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), b.num_rows]):
                now, kind = (int(key[0, lo]), int(key[1, lo])), key[2, lo]
                if now != at:
                    at, members, part, order = now, [], None, int(now[0] >= first_of_second)
                if kind == 0:
                    members.append(x[lo:hi])
                    continue
                if not members:
                    continue
                if part is None:
                    part = Part(np.concatenate(members), most, leading_bits(most, order))
                    yield out(part.neighbours())
                yield out(part.links(x[lo:hi]))

    return run


def near_links(prints: DataFrame, most: int) -> DataFrame:
    """Links ``(u, v)`` between the distinct fingerprints ``fp`` (long) that join all within ``most`` bits.

    Links within a class may be fewer than all pairs, but whatever can be reached can be reached over them. Numbers that
    go to the driver, and from there to all tasks, are two for each cut and each upper node: at most ``MOST_PARTS`` an
    order. A dense class costs its members, since runs wholly in a query's own class are pruned.
    """
    spark = prints.sparkSession
    context = spark.sparkContext
    n = prints.count()
    parts = max(1, min(MOST_PARTS, -(-n // PART_ROWS)))
    cuts = [np.zeros(0, np.uint64)] * _ORDERS
    if parts > 1:
        at = F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)])
        ranked = prints.select(*[_rank(order)("fp").alias(f"rank{order}") for order in range(_ORDERS)])
        quantiles = ranked.agg(*[F.percentile_approx(f"rank{order}", at, F.lit(20 * parts)) for order in range(_ORDERS)]).first()
        cuts = [np.unique(np.array(q, np.int64).view(np.uint64) ^ np.uint64(1 << 63)) for q in quantiles]
    shared = context.broadcast(cuts)
    members = prints.select("fp").mapInArrow(_placed(shared), "part int, x long")
    nodes = members.groupBy("part").agg(F.bit_and("x").alias("both"), F.bit_or("x").alias("some")).collect()
    upper = []
    for order in range(_ORDERS):
        first = order * (len(cuts[0]) + 1)
        both, some = (np.zeros(len(cuts[order]) + 1, np.uint64) for _ in range(2))
        for r in nodes:
            if 0 <= r["part"] - first < len(both):
                both[r["part"] - first], some[r["part"] - first] = r["both"] % (1 << 64), r["some"] % (1 << 64)
        upper.append((both, some))
    queries = prints.select("fp").mapInArrow(_routed(shared, context.broadcast(upper), most), "part int, x long")
    queries = materialize(queries, "routed")
    slices = queries.groupBy("part").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("slices"))
    slices = F.broadcast(materialize(slices, "slices"))  # one row for each upper node
    whole = members.join(slices, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), "x")
    asked = queries.join(slices, "part").select("part", F.pmod(F.xxhash64("x"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), "x")
    dealt = whole.unionAll(asked).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "slice")
    links = dealt.sortWithinPartitions("part", "slice", "kind").mapInArrow(_search(len(cuts[0]) + 1, most), "u long, v long")
    links = materialize(links.distinct(), "links")
    discard(queries)
    return links


def _rank(order: int):
    @F.arrow_udf("long")
    def run(fp: pa.Array) -> pa.Array:
        return pa.array((gray_rank(turned(fp.to_numpy().view(np.uint64), order)) ^ np.uint64(1 << 63)).view(np.int64))

    return run
