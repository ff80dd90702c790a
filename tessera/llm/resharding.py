"""Minimum-cost-flow resharding: new shards of equal row counts, reached by moving the fewest bytes.

An old shard gives up rows beyond its new capacity, its smallest ones first. So its rows fall into three blocks: those
below the size at which it stops giving, those of that size, and those above. The sizes are found exactly, by counting
prefixes of sizes ten bits at a time. A block is a node of the network; its rows stay at no cost or pass a hub at their
size, to the shards with room. The network has three nodes for each old shard whatever the table's size, so the driver solves
it exactly. The flow is then read back as intervals of ranks, and a row's rank comes from counts of parts and its place in
its part: one shuffle of narrow rows, no sort of a whole shard. Shards that gain or lose rows are written anew.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .base import materialize, shared_root, table, utf8

OLD_SHARDS, NEW_SHARDS = 32, 40
#: Rows a part of a block holds on average; a task ranks the rows of whole parts.
BLOCK_ROWS = 20_000
#: Bits of a size that are counted at a time.
STEP = 10
BELOW, AT, ABOVE = 0, 1, 2
#: Bytes a row takes besides its text.
ROW_BYTES = 16


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a cheapest maximum flow: successive shortest paths."""
    to, room, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for end, capacity, price, start in ((b, c, w, a), (a, 0, -w, b)):
            out[start].append(len(to))
            to.append(end)
            room.append(capacity)
            cost.append(price)
    height = [0] * n
    while True:
        far, via, heap = [None] * n, [-1] * n, [(0, source)]
        far[source], done = 0, [False] * n
        while heap:
            d, a = heapq.heappop(heap)
            if done[a]:
                continue
            done[a] = True
            for e in out[a]:
                if room[e] and not done[to[e]]:
                    longer = d + cost[e] + height[a] - height[to[e]]
                    if far[to[e]] is None or longer < far[to[e]]:
                        far[to[e]], via[to[e]] = longer, e
                        heapq.heappush(heap, (longer, to[e]))
        if far[sink] is None:
            return [room[2 * i + 1] for i in range(len(arcs))]
        top = max(d for d in far if d is not None)
        height = [h + (top if d is None else d) for h, d in zip(height, far)]
        path, a = [], sink
        while a != source:
            path.append(via[a])
            a = to[via[a] ^ 1]
        least = min(room[e] for e in path)
        for e in path:
            room[e] -= least
            room[e ^ 1] += least


def solve(cells: list[tuple[int, int, int, int]], new_shards: int) -> tuple[dict[tuple[int, int], int], list[int]]:
    """Rows that stay, by (old shard, block), and rows each new shard receives from others.

    ``cells`` are (old shard, block, rows, bytes), with blocks in order of size. Every new shard ends with the mean number of rows, rounded down
    or up; which ones are rounded up is part of the solution.
    """
    rows = sum(c[2] for c in cells)
    floor, extra = divmod(rows, new_shards)
    first, hub = 2, 2 + len(cells)
    shard = [hub + 1 + j for j in range(new_shards)]
    spare = hub + 1 + new_shards
    arcs = [(0, first + i, c[2], 0) for i, c in enumerate(cells)]
    stay = len(arcs)
    arcs += [(first + i, shard[c[0]] if c[0] < new_shards else hub, c[2] if c[0] < new_shards else 0, 0) for i, c in enumerate(cells)]
    arcs += [(first + i, hub, c[2], max(1, c[3] // max(1, c[2]))) for i, c in enumerate(cells)]
    move = len(arcs)
    arcs += [(hub, s, rows, 0) for s in shard]
    arcs += [(s, 1, floor, 0) for s in shard] + [(s, spare, 1, 0) for s in shard] + [(spare, 1, extra, 0)]
    flow = min_cost_flow(spare + 1, arcs, 0, 1)
    return {(c[0], c[1]): flow[stay + i] for i, c in enumerate(cells)}, flow[move : move + new_shards]


def old_shard(old_shards: int = OLD_SHARDS) -> Column:
    """Where a document lay before: crc32 of its id as text, modulo the old number of shards; null ids in shard 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % old_shards, F.lit(0)).cast("int")


def stopping_sizes(slim: DataFrame, given: dict[int, int]) -> dict[int, int]:
    """The size of the row at which each old shard stops giving, if it gives so many of its smallest rows."""
    spark, prefix, ahead = slim.sparkSession, dict.fromkeys(given, 0), dict.fromkeys(given, 0)
    for low in range(40 - STEP, -1, -STEP):
        at = F.broadcast(spark.createDataFrame(sorted(prefix.items()), "old_shard int, prefix long"))  # one row for each old shard
        here = slim.join(at, "old_shard").where(F.shiftright("size", low + STEP) == F.col("prefix"))
        counted: dict[int, list[tuple[int, int]]] = {}
        for r in here.groupBy("old_shard", F.shiftright("size", low).alias("bin")).agg(F.count("*").alias("n")).collect():  # at most 2**STEP a shard
            counted.setdefault(r["old_shard"], []).append((r["bin"], r["n"]))
        for shard, bins in counted.items():
            for number, n in sorted(bins):
                prefix[shard] = number
                if ahead[shard] + n >= given[shard]:
                    break
                ahead[shard] += n
    return prefix


def reshard(docs: DataFrame, old: Column | None = None, new_shards: int = NEW_SHARDS, carry: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, old_shard, shard, slot, moved`` for each input row, and (``carry``) the row itself as ``row``.

    Row counts of the new shards differ by one at most, and rows are moved so that the fewest bytes move. ``size`` is the
    text's UTF-8 bytes plus 16; a null text counts as empty. Repeated rows are rows of their own. Slots are gapless from 0
    in each shard. An empty table gives an empty result; other columns are carried whatever their names. ``old`` gives the
    old shard of a row, not null and below ``new_shards`` unless that old shard is to be dissolved.
    """
    spark = docs.sparkSession
    own = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(utf8(F.col("text"))).alias("text_crc32"),
        (old_shard() if old is None else old).cast("int").alias("old_shard"),
        F.struct(*docs.columns).alias("row"),
    ).withColumn("read_by", F.spark_partition_id())  # tells equal rows apart
    slim = materialize(own.drop("row"), "sizes")
    rows = {r["old_shard"]: r["n"] for r in slim.groupBy("old_shard").agg(F.count("*").alias("n")).collect()}  # one for each old shard
    floor = sum(rows.values()) // new_shards
    gives = {s: n if s >= new_shards else n - floor for s, n in rows.items()}
    ends = stopping_sizes(slim, {s: n for s, n in gives.items() if n > 0})
    at = F.broadcast(spark.createDataFrame(sorted(ends.items()), "old_shard int, end long"))
    block = F.when(F.col("end").isNull() | (F.col("size") > F.col("end")), ABOVE).when(F.col("size") == F.col("end"), AT).otherwise(BELOW)
    with_block = lambda df: df.join(at, "old_shard", "left").withColumn("block", block.cast("int")).drop("end")
    slim = with_block(slim)
    cells = sorted(tuple(r) for r in slim.groupBy("old_shard", "block").agg(F.count("*"), F.sum("size")).collect())  # three a shard
    stays, takes = solve(cells, new_shards)

    per_shard: dict[int, int] = {}
    plan, passed = [], 0
    for shard, of, n, _ in cells:
        plan.append((shard, of, stays[shard, of], per_shard.get(shard, 0), passed))
        per_shard[shard] = per_shard.get(shard, 0) + stays[shard, of]
        passed += n - stays[shard, of]
    begin = [sum(takes[:j]) for j in range(new_shards)]
    plan_df = spark.createDataFrame(plan, "old_shard int, block int, stay long, stay_at long, hub_at long")

    parts = max(1, -(-max((c[2] for c in cells), default=0) // BLOCK_ROWS))
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "read_by"), F.lit(parts)).cast("int")
    count = slim.groupBy("old_shard", "block", part.alias("part")).agg(F.count("*").alias("n"))
    dealt = (with_block(own) if carry else slim).withColumn("part", part)
    before = Window.partitionBy("old_shard", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select("old_shard", "block", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_at"))
    inside = Window.partitionBy("old_shard", "block", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(count, ["old_shard", "block", "part"])
        .join(F.broadcast(plan_df), ["old_shard", "block"])  # three rows for each old shard
        .withColumn("rank", F.col("part_at") + F.col("place"))
    )
    moved = F.col("rank") >= F.col("stay")
    at_hub = F.col("hub_at") + F.col("rank") - F.col("stay")
    goes, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for j in range(new_shards):  # the last interval that begins at or before the row's place in the hub
        if takes[j]:
            goes = F.when(at_hub >= F.lit(begin[j]), F.lit(j)).otherwise(goes)
            slot = F.when(at_hub >= F.lit(begin[j]), at_hub - F.lit(begin[j] - per_shard.get(j, 0))).otherwise(slot)
    return ranked.select(
        "doc_id", "size", "text_crc32", "old_shard",
        F.when(moved, goes).otherwise(F.col("old_shard")).cast("int").alias("shard"),
        F.when(moved, slot).otherwise(F.col("stay_at") + F.col("rank")).cast("long").alias("slot"),
        moved.alias("moved"), *(["row"] if carry else []),
    )


def rewrite(docs: DataFrame, path: str, old: Column | None = None, new_shards: int = NEW_SHARDS) -> DataFrame:
    """Write the new content of every shard that gains or loses a row below ``path`` and return all rows with their places.

    A shard's folder is ``shard=N``; a file's rows are in order of ``slot``, each with the input row as ``row``, so no column's
    name can clash. Shards that no move touches are left as they are. Texts move once, with the rows they are ranked with.
    Equal rows are told apart by the task that reads them, so ``docs`` has to be stored tables, read alike each time; what was
    written is held against the places, and a difference is an error. The result is read from what was written, where it was.
    """
    placed = reshard(docs, old, new_shards, carry=True)
    spot = materialize(placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot", "moved"), "places")
    touched = spot.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    touched = F.broadcast(materialize(touched, "touched"))  # one row for each shard at most
    changed = placed.join(touched, "shard")
    changed.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    kept = spot.join(touched, "shard", "left_anti").select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot", "moved")
    kinds = {f.name: f for f in changed.schema.fields}
    written = docs.sparkSession.read.schema(T.StructType([kinds[c] for c in ("row", "size", "old_shard", "slot", "moved", "shard")])).parquet(path)
    crc = F.crc32(utf8(F.col("row.text"))).alias("text_crc32")
    told = lambda df: sorted(tuple(r) for r in df.groupBy("shard").agg(F.count("*"), F.sum("slot"), F.sum("size")).collect())
    if told(written) != told(spot.join(touched, "shard", "left_semi")):  # one row for each shard
        raise RuntimeError("the documents were read in another order the second time")
    return kept.unionAll(written.select("row.doc_id", "size", crc, "old_shard", "shard", "slot", "moved"))


def query(spark, sf_dir: str) -> DataFrame:
    placed = rewrite(table(spark, sf_dir, "documents"), f"{shared_root(spark)}/tessera/resharded-{uuid.uuid4().hex}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
