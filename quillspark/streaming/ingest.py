"""Append-only JSON lines as a stream: validated, counted, written once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..sources import appendlog


def records(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """A stream of (record variant, bad) over the lines of the files that arrive in a folder."""
    rows = spark.readStream.option("maxFilesPerTrigger", files).text(folder).where(~T.blank(F.col("value")))
    rows = rows.withColumn("record", F.try_parse_json("value"))
    return rows.withColumn("bad", ~F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False)))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Takes in what has arrived and ends; good and bad lines are partitions of one table, each line written once."""
    writer = records(spark, folder).select("bad", "value").writeStream.format("parquet").partitionBy("bad")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_batches(spark: SparkSession, folder: str, base: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Takes in what has arrived, so many files at a time, and ends: sinks `good` and `bad` of an append log, a batch of it for each batch of the stream.

    A batch that the stream repeats after a failure has its commit already or left none, so each line counts once. The name of the
    checkpoint tells its batches from those of another checkpoint over the same log.
    """
    rows = records(spark, folder, files).select("bad", "value")
    sink = F.when(F.col("bad"), "bad").otherwise("good")
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    keep = lambda batch, number: appendlog.append(batch.select("value", "bad"), sink, base, f"{name}-{number}")
    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
