"""Manual reviews, quality gate, manifests, recommendations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import arrowfiles

# Verdicts from best to worst, and the outcomes of a review.
VERDICTS = ["ACCEPT", "REVISE", "REJECT"]
OUTCOMES = ["pass", "reject", "revise", "unclear"]
# The checks of a review by what their line says.
CHECKS = {
    "main_claim_supported": "main_claim",
    "method_supported": "method",
    "limitations_supported": "limitations",
    "no_unsupported_claim": "No unsupported scientific claim",
    "confidence_plausible": "confidence label",
}
# The lines of a review that are read.
RECORD, IDENTIFIER = r"(?m)^## Record\s+(\d+):\s*(.*?)\s*$", r"(?m)^- arXiv ID:\s*`?([^`\n]+)`?\s*$"
NOTES, OUTCOME = r"(?m)^- \[[ xX]\]\s+Notes:\s*(.*?)\s*$", r"(?m)^Review outcome:\s*`?([^`\n]+)`?\s*$"


def rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)


def verdict(rank_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VERDICTS)), rank_.cast("int"))


def review_records(files: DataFrame, checks: dict[str, str] = CHECKS) -> DataFrame:
    """files(path, text) -> one row per `## Record n:` section: record_index, title, arxiv_id, checks, notes, outcome, fully_checked.

    The outcome is the whole line, with or without back quotes; a line that is none of OUTCOMES, the template's as well,
    is unclear. A file without such a section gives no rows (see review_error()).
    """
    rows = files.select("path", F.explode(F.split("text", r"(?m)(?=^## Record\s+\d+:)")).alias("s")).where(F.col("s").rlike(r"\A## Record\s+\d+:"))
    get = lambda pattern, group=1: T.trim(F.regexp_extract("s", pattern, group))
    ticked = lambda c: F.lower(F.regexp_extract("s", rf"(?m)^- \[([ xX])\]\s+.*\Q{c}\E.*$", 1)) == "x"
    outcome = F.lower(get(OUTCOME))
    rows = rows.select(
        "path", get(RECORD).cast("long").alias("record_index"), get(RECORD, 2).alias("title"), F.when(get(IDENTIFIER) == "-", "").otherwise(get(IDENTIFIER)).alias("arxiv_id"),
        F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), ticked(c))]).alias("checks"), get(NOTES).alias("notes"),
        F.when(outcome.isin(OUTCOMES), outcome).otherwise("unclear").alias("outcome"),
    )
    return rows.withColumn("fully_checked", F.forall(F.map_values("checks"), lambda x: x))


def review_error(text: Column) -> Column:
    """Why a file is no review; null if it is one."""
    return F.when(T.blank(text), "empty").when(~text.rlike(RECORD), "no record")


def review_summary(reviews: DataFrame, checks: dict[str, str] | None = None) -> DataFrame:
    """reviews(outcome, fully_checked) -> one row: counts of each outcome and the status, PASS only if all passed; with checks also how often each is ticked."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    ticked = [F.count_if(F.coalesce(F.try_element_at("checks", F.lit(c)), F.lit(False))).alias(c) for c in checks or {}]
    out = reviews.agg(F.count("*").alias("total_records"), *counts, F.count_if("fully_checked").alias("fully_checked"), *ticked)
    return out.withColumn("status", review_status(F.col("total_records"), F.col("pass"), F.col("reject"), F.col("revise"), F.col("fully_checked")))


def review_status(total: Column, passed: Column, reject: Column, revise: Column, fully_checked: Column) -> Column:
    # The statuses of a review.
    return (
        F.when((passed == total) & (fully_checked == total) & (total > 0), "PASS")
        .when(reject > 0, "REVIEW_REJECTED_RECORDS")
        .when(revise > 0, "REVIEW_REVISIONS_NEEDED")
        .otherwise("REVIEW_INCOMPLETE")
    )


def manifest_verdict(status: Column, missing: Column, files: Column) -> Column:
    return F.when((missing > 0) | (files == 0), "REJECT").when(F.coalesce(status, F.lit("")) != "PASS", "REVISE").otherwise("ACCEPT")


def summary_verdict(status: Column, total: Column, reject: Column, fully_checked: Column) -> Column:
    """A review whose status is PASS is not rejected, whatever its counts say."""
    rejected = (F.coalesce(status, F.lit("")) != "PASS") & ((status == "REVIEW_REJECTED_RECORDS") | (reject > 0))
    revise = (F.coalesce(status, F.lit("")) != "PASS") | (total <= 0) | (fully_checked < total)
    return F.when(rejected, "REJECT").when(revise, "REVISE").otherwise("ACCEPT")


def gate(manifest: str, reviews: DataFrame, require_review: bool = True) -> DataFrame:
    """reviews(verdict) and the manifest's verdict -> the worst of all; without a review REVISE at best, if one is required."""
    worst = reviews.agg(F.max(rank(F.col("verdict"))).alias("r"), F.count("*").alias("reviews"))
    least = F.when((F.col("reviews") == 0) & F.lit(require_review), 2).otherwise(1)
    return worst.select(verdict(F.greatest(rank(F.lit(manifest)), F.coalesce("r", F.lit(1)), least)).alias("decision"), "reviews")


def recommendation(manifest_status: Column, missing: Column, decision: Column) -> Column:
    # What a pilot's report recommends.
    return (
        F.when((F.coalesce(manifest_status, F.lit("")) != "PASS") | (missing > 0), "FIX_TRACEABILITY")
        .when(decision.isNull(), "RUN_QUALITY_GATE")
        .when(decision == "ACCEPT", "READY_FOR_NEXT_PILOT_CYCLE")
        .when(decision == "REJECT", "STOP_AND_FIX")
        .when(decision == "REVISE", "REVISE_BEFORE_SCALING")
        .otherwise("INVESTIGATE_GATE_STATUS")
    )


def file_entries(spark, wanted: list[tuple[str, str]], base: str | None = None) -> DataFrame:
    """(path, role) pairs, each once -> one row each: exists, size_bytes, sha256, record_count, json_top_level_type, with base also relative_path.

    The files asked for, and no others, are looked up; one that isn't there, or is a folder, doesn't exist. Tasks read a file in blocks, so its size is
    not bound by memory; of a JSON document of more than arrowfiles.WHOLE bytes the first and last sign tell the type, and null stands for any but objects and
    lists. A store that only Spark can open is read by Spark, a file in one row.
    """
    if any(T.is_blank(role) for _, role in wanted):
        raise ValueError("a file needs a role")
    pairs = list(dict.fromkeys((p, r.strip()) for p, r in wanted))
    asked = spark.createDataFrame([(*pair, n) for n, pair in enumerate(pairs)], "path string, role string, pos long")
    there = [p for p in dict.fromkeys(p for p, _ in pairs) if p.strip() and is_file(spark, p)]
    own, left = [p for p in there if arrowfiles.opens(p)], [p for p in there if not arrowfiles.opens(p)]
    paths = spark.createDataFrame([(p,) for p in own], "path string")
    read = arrowfiles.contents(paths.repartition(max(1, min(len(own), 4 * spark.sparkContext.defaultParallelism)), "path"))
    if left:
        plain = lambda p: re.sub(r"([\[\]{}*?,\\])", r"\\\1", p)
        content = F.col("content").cast("string")
        lines = F.when(F.col("path").endswith(".jsonl"), F.size(F.filter(F.split(content, "\n"), lambda x: ~T.blank(x))).cast("long"))
        rest = spark.read.format("binaryFile").load([plain(p) for p in left])
        read = read.union(rest.select("path", "length", F.sha2("content", 256), lines, F.when(F.col("path").endswith(".json"), content), F.lit(None).cast("string")))
    top = F.schema_of_variant(F.try_parse_json("text"))
    kind = F.when(top.startswith("OBJECT"), "object").when(top.startswith("ARRAY"), "list").otherwise(F.coalesce(F.lower(top), "kind"))
    kind = F.when(F.col("path").endswith(".jsonl"), "jsonl").when(F.col("path").endswith(".json"), kind)
    read = read.select(plain_path(F.col("path")).alias("__path"), "size_bytes", "sha256", "record_count", kind.alias("json_top_level_type"))
    out = asked.join(read, plain_path(F.col("path")) == F.col("__path"), "left").drop("__path").withColumn("exists", F.col("size_bytes").isNotNull())
    if base is None:
        return out
    prefix = base.rstrip("/") + "/"
    return out.withColumn("relative_path", F.when(F.col("path").startswith(prefix), F.substr("path", F.lit(len(prefix) + 1), F.length("path"))).otherwise(F.col("path")))


def is_file(spark, path: str) -> bool:
    """Whether a path is a file, in any store that Hadoop opens."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isFile()


def plain_path(path: Column) -> Column:
    """A path as it is written without the scheme of local files."""
    return F.regexp_replace(path, "^file:(?://)?", "")


def manifest_summary(entries: DataFrame) -> DataFrame:
    """One row: files, missing ones and their paths in order, records in extractions, status."""
    out = entries.agg(
        F.count("*").alias("files"), F.count_if(~F.col("exists")).alias("missing"), F.sum(F.when(F.col("role") == "jsonl_extractions", F.col("record_count"))).alias("extraction_records"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("exists"), F.struct("pos", "path")))), lambda m: m["path"]).alias("missing_paths"),
    )
    return out.withColumn("status", F.when((F.col("missing") == 0) & (F.col("files") > 0), "PASS").otherwise("WARN"))


def role_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.coalesce(F.nullif("role", F.lit("")), F.lit("<missing>")).alias("role")).agg(F.count("*").alias("files"))


def markdown(rows: DataFrame, line: Column, order: list[str], title: str) -> DataFrame:
    """One row: a report with a line per row, in order. For reports of bounded size: the rows are gathered."""
    parts = rows.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("all"))
    return parts.select(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n")).alias("report"))
