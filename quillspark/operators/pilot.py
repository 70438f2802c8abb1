"""What a pilot has come to: formal summaries and reviews added up, and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gate

#: What to do next, by recommendation; a pilot under revision differs by whether a review is there.
NEXT = {
    "FIX_TRACEABILITY": ["supply the files that the manifest misses", "make the manifest again"],
    "RUN_QUALITY_GATE": ["run the gate over the manifest", "let it fail only once reviews are complete"],
    "READY_FOR_NEXT_PILOT_CYCLE": ["freeze these outputs as the baseline", "change one thing in the next cycle", "train nothing before several runs are accepted"],
    "STOP_AND_FIX": ["look at the rejected records", "mend prompt, schema or filter", "run the same metadata again"],
    "REVISE_BEFORE_SCALING": ["look at records to revise or unclear", "change prompt or schema for errors that repeat", "run the same metadata again"],
    "INVESTIGATE_GATE_STATUS": ["read the gate's report"],
}
UNREVIEWED = ["fill in the review sheets", "summarise them", "make the manifest again and run the gate"]


def formal(summaries: DataFrame) -> DataFrame:
    """summaries(evaluation_status, total_records) -> (status, summaries, records)."""
    status = F.coalesce(F.nullif("evaluation_status", F.lit("")), F.lit("<missing>"))
    return summaries.groupBy(status.alias("status")).agg(F.count("*").alias("summaries"), F.sum(F.coalesce("total_records", F.lit(0))).alias("records"))


def manual(reviews: DataFrame) -> DataFrame:
    """reviews(status, total_records, fully_checked and the outcomes) -> one row of sums."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c)
    return reviews.agg(F.count("*").alias("reviews"), *[total(c) for c in ("total_records", "fully_checked", *gate.OUTCOMES)])


def review_statuses(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("<missing>")).alias("status")).agg(F.count("*").alias("reviews"))


def next_actions(recommendation: Column, reviews: Column) -> Column:
    steps = lambda own: F.array(*map(F.lit, own))
    out = steps(NEXT["INVESTIGATE_GATE_STATUS"])
    for name, own in NEXT.items():
        out = F.when(recommendation == name, steps(own)).otherwise(out)
    return F.when((recommendation == "REVISE_BEFORE_SCALING") & (reviews == 0), steps(UNREVIEWED)).otherwise(out)


def analysis(manifest: DataFrame, entries: DataFrame, summaries: DataFrame, reviews: DataFrame, decision: str | None) -> DataFrame:
    """One row: manifest(name, status, missing_paths), its entries(path, role, record_count), and what the summaries and reviews say.

    Each part is one row of sums, so their product is one row.
    """
    head = manifest.select("name", F.col("status").alias("manifest_status"), F.size(F.coalesce("missing_paths", F.array().cast("array<string>"))).alias("missing"))
    counts = entries.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(F.col("role") == "jsonl_extractions", F.coalesce("record_count", F.lit(0)))), F.lit(0)).alias("extraction_records"))
    told = summaries.agg(F.count("*").alias("formal_summaries"), F.count_if(F.col("evaluation_status") == "PASS").alias("formal_pass"), F.coalesce(F.sum("total_records"), F.lit(0)).alias("formal_records"))
    out = head.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(told)).crossJoin(F.broadcast(manual(reviews)))
    out = out.withColumn("decision", F.lit(decision).cast("string"))
    out = out.withColumn("recommendation", gate.recommendation(F.col("manifest_status"), F.col("missing"), F.col("decision")))
    return out.withColumn("next_actions", next_actions(F.col("recommendation"), F.col("reviews")))
