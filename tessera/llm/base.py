"""What the corpus operators share: reading tables, and cutting lineage in shared storage."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize, shared_root, small_batches

__all__ = ["discard", "fresh", "held", "join_salted", "materialize", "shared_root", "small_batches", "table", "utf8"]

#: Bytes that separate words: space and the controls 9 to 13. ``bytes.split()`` cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"

MASK64 = (1 << 64) - 1
#: Parts that the rows of a hot key are dealt to.
SALTS = 64

_HELD: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What an operator's kernels remember in this worker from task to task.

    Workers outlive the stage they were made for, and an executor's limit counts all of them. So what other operators
    remember is dropped, and memory that is free goes back to the system.
    """
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)
    return _HELD[owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, for a helper column beside its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_salted(rows: DataFrame, keyed: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``keyed``, which has one row for each ``key`` (not null) and the number ``n`` of its rows.

    A key with more than a thousandth of all rows has its row in ``keyed`` copied for each salt; there are fewer than a
    thousand such keys, so telling them to all tasks is bounded.
    """
    total = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(keyed.where(F.col("n") * 1000 > max(total, 1000)).select(*key, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, key, "left").withColumn("salt", salt).drop("hot")
    right = keyed.drop("n").join(hot, key, "left").withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, [*key, "salt"]).drop("salt")


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")
