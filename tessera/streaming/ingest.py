"""Continuous ingestion: documents as they arrive in a folder, to outcomes. Each document stands alone, so there is no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import ingest
from tessera.options import ReadOptions
from tessera.sources.documents import PATTERN


def stream_folder(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``doc_id, path, content``."""
    kinds = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kinds).option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def stream_outcomes(documents: DataFrame, options: ReadOptions | None = None) -> DataFrame:
    """A stream of each document's failure or structure. One that isn't admitted fails as ``Admission``."""
    options = options or ReadOptions()
    taken = ingest.admitted(documents, options)
    admitted = ingest.scanned(taken, options).withColumn("outcome", F.coalesce("failure", F.lit("Success")))
    kept = ["doc_id", "outcome", "err_offset", "max_nesting_depth", "max_object_members", "total_values", "decoded_member_name_bytes"]
    null = lambda c: F.lit(None).cast("long").alias(c)
    refused = taken.where("NOT admitted").select("doc_id", F.lit("Admission").alias("outcome"), *[null(c) for c in kept[2:]])
    return admitted.select(*kept).unionByName(refused)


def write_outcomes(documents: DataFrame, out: str, checkpoint: str, options: ReadOptions | None = None) -> StreamingQuery:
    """Append outcomes to a Parquet folder, each document once, and stop when all that is there has been read."""
    found = stream_outcomes(documents, options)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
