"""Writers: JSON lines with sorted keys, reports, vector caches."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import frozen


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One object a line with keys in order; mode append adds to what is there."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def append_valid(df: DataFrame, valid, path: str, quarantine: str) -> None:
    """Valid rows are appended; the others go to the quarantine and never reach the sink.

    Rows are computed once and rest in the shared folder, so what a model said for one sink is what the other got.
    """
    once = frozen(df.withColumn("__valid", F.coalesce(valid, F.lit(False))))
    write_jsonl(once.where("__valid").drop("__valid"), path, "append")
    write_jsonl(once.where("NOT __valid").drop("__valid"), quarantine, "append")


def write_report(spark: SparkSession, report: dict[str, Any], path: str) -> str:
    """A small report as indented JSON with sorted keys, by Spark's writer so that any store can hold it."""
    body = json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def write_vectors(vectors: DataFrame, path: str) -> str:
    """A cache of vectors by model, which read_vectors() reads back with partition pruning."""
    rounded = vectors.withColumn("v", F.transform("v", lambda x: F.round(x, 8)))
    rounded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_key").parquet(path)
    return path


def read_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("model_key") == model)
