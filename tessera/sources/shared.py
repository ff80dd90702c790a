"""Tables written to storage that all executors share, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A free path in a new folder below the shared one; the folder goes when the application ends."""
    folder = f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)  # what isn't there yet can't be marked
    files.deleteOnExit(target)
    return folder + "/table"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts lineage: a lost executor costs the tasks it ran, never the work before the cut. What is read later is
    pruned to the columns and row groups it needs.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return made


def discard(made: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing that is still to run reads it.

    The shuffles it was made from go as well: Spark deletes those whose plans the driver has forgotten.
    """
    target = made._written_at
    target.getFileSystem(made.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    made.sparkSession.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, most_bytes: int = 32 << 20) -> None:
    """Bound an Arrow batch by rows as well as bytes, since one document may be megabytes long."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))):
        spark.conf.set(key, value)
