"""Tables that rest in the shared folder, and tables small enough to be sent to every task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only a session on one machine may make its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def frozen(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once and read from there: later steps don't compute it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def if_small(table: DataFrame, most: int = 1 << 20) -> DataFrame:
    """table, to be sent to every task if it has at most so many rows; else as it is, for Spark to join by key."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def pinned(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns, each computed once a row.

    Projections in a row are merged, and an expression that a lambda refers to would then be evaluated for each
    element of its array. A generator of one row stands between.
    """
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly if it lies in fewer splits than there are cores, as one small file does: text is worked on by all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
