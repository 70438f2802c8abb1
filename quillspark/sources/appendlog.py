"""Appending in batches that count once: data first, then one commit for all sinks; what has no commit isn't there."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch string, attempt string, rows map<string,long>"


def _hadoop(spark: SparkSession, path: str):
    """(path, file system) as Hadoop has them, so that any store will do."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, base: str) -> DataFrame:
    """(batch, attempt, rows by sink), one row a batch that counts."""
    place, files = _hadoop(spark, f"{base}/commits")
    if not files.exists(place):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).option("mode", "FAILFAST").json(f"{base}/commits")


def committed(spark: SparkSession, base: str, batch: str) -> dict | None:
    """A batch's commit, or None."""
    place, files = _hadoop(spark, f"{base}/commits/{batch}.json")
    if not files.exists(place):
        return None
    return spark.read.schema(COMMIT).option("mode", "FAILFAST").json(str(place)).first().asDict()


def stage(rows: DataFrame, sink: Column, base: str, batch: str) -> dict:
    """Writes a batch's rows below a folder of this attempt, by sink, in one pass over them; readers don't see them yet.

    Rows are counted as they go out, and again, by sink, as they lie there.
    A row whose sink is null goes to `none`. Objects have their keys in order and keep null fields.
    """
    attempt, seen = uuid.uuid4().hex, Observation()
    body = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    out = rows.select(F.coalesce(sink.cast("string"), F.lit("none")).alias("sink"), body.alias("value"))
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"))
    path = f"{base}/data/batch={batch}/attempt={attempt}"
    out.write.mode("errorifexists").partitionBy("sink").text(path)
    total, per = seen.get["rows"], {}
    if total:
        written = rows.sparkSession.read.schema("value string, sink string").text(path)
        per = {r["sink"]: r["count"] for r in written.groupBy("sink").count().collect()}
    if sum(per.values()) != total:
        raise OSError(f"batch {batch}: {total} rows went out, {sum(per.values())} lie in {path}")
    return {"batch": batch, "attempt": attempt, "rows": per}


def commit(spark: SparkSession, base: str, done: dict) -> bool:
    """Makes a staged attempt count, by renaming one file; False if another attempt of the batch counts already."""
    final, files = _hadoop(spark, f"{base}/commits/{done['batch']}.json")
    draft, _ = _hadoop(spark, f"{base}/commits/_{done['batch']}-{done['attempt']}")
    out = files.create(draft, True)
    out.write((json.dumps(done, sort_keys=True) + "\n").encode())
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), none)
    except Exception:
        if not files.exists(final):
            raise
        files.delete(draft, False)
        return False
    return True


def append(rows: DataFrame, sink: Column, base: str, batch: str) -> dict:
    """Appends a batch to its sinks, all or nothing and once: its commit, which a batch of that name may have already.

    A batch that counts is not computed again. One that was cut short at any point left no commit, so it is appended anew and what it
    left is never read. Of two attempts at once the first commit counts, and both return that one.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError(f"a batch's name holds letters, digits, points, dashes and underscores: {batch!r}")
    spark = rows.sparkSession
    known = committed(spark, base, batch)
    if known is None:
        done = stage(rows, sink, base, batch)
        known = done if commit(spark, base, done) else committed(spark, base, batch)
    return known


def read(spark: SparkSession, base: str, sink: str, schema: str) -> DataFrame:
    """A sink's rows with their batch, of attempts that count alone: a join with the commits, by which Spark leaves out folders."""
    whole = f"{schema}, batch string, attempt string, sink string"
    counted = commits(spark, base)
    if counted.where(F.map_contains_key("rows", F.lit(sink))).isEmpty():
        return spark.createDataFrame([], f"{schema}, batch string")
    rows = spark.read.schema(whole).option("mode", "FAILFAST").json(f"{base}/data").where(F.col("sink") == sink)
    return rows.join(F.broadcast(counted.select("batch", "attempt")), ["batch", "attempt"], "left_semi").drop("attempt", "sink")


def leftovers(spark: SparkSession, base: str, hours: float = 24.0) -> list[str]:
    """Folders of attempts without a commit that are older than so many hours, which no run can still be writing."""
    counted = {(r["batch"], r["attempt"]) for r in commits(spark, base).select("batch", "attempt").collect()}
    place, files = _hadoop(spark, f"{base}/data/batch=*/attempt=*")
    found, before = [], (time.time() - hours * 3600) * 1000
    for status in files.globStatus(place) or []:
        path = status.getPath()
        own = (path.getParent().getName().partition("=")[2], path.getName().partition("=")[2])
        if own not in counted and status.getModificationTime() <= before:
            found.append(path.toString())
    return sorted(found)


def clear(spark: SparkSession, base: str, hours: float = 24.0) -> int:
    """Deletes leftovers(); how many there were."""
    old = leftovers(spark, base, hours)
    for path in old:
        place, files = _hadoop(spark, path)
        files.delete(place, True)
    return len(old)
