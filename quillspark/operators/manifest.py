"""Manifests: what files a run has left, in what roles, and what a report says about them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import gate

# The roles of files in a benchmark's folder by their names, in the order in which they are listed.
ROLES = [
    (r"^metadata_.*\.json$", "metadata"),
    (r"\.jsonl$", "jsonl_extractions"),
    (r"^(?!.*_manual_review_summary\.json$).*_summary\.json$", "summary"),
    (r"_manual_quality_checklist\.md$", "manual_quality_checklist"),
    (r"_manual_review_summary\.json$", "manual_review_summary"),
    (r"^benchmark_quality_workflow_report\.json$", "workflow_report"),
    (r"^quality_gate_report\.json$", "quality_gate_report"),
    (r"^pilot_report\.json$", "pilot_report"),
    (r"^mini_benchmark_report\.json$", "benchmark_report"),
]
# The context of a run that a manifest names.
CONTEXT = ["backend", "model", "prompt_version", "prompt_template_sha256", "extraction_schema_version"]


def roles(names: DataFrame) -> DataFrame:
    """names(path) -> (path, role, pos) of the files whose name says their role, in order of role, then path."""
    name = F.element_at(F.split("path", "/"), -1)
    each = [F.when(name.rlike(pattern), F.struct(F.lit(n).alias("pos"), F.lit(role).alias("role"))) for n, (pattern, role) in enumerate(ROLES)]
    found = names.select("path", F.explode(F.array_compact(F.array(*each))).alias("r")).select("path", "r.role", "r.pos")
    return found.orderBy("pos", "path")


def discover(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(path, role) of the files of a benchmark's folder; a folder that isn't there is an error. For folders of a run, some dozens of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder).select(gate.plain_path(F.col("path")).alias("path"))
    return [(r["path"], r["role"]) for r in roles(files).collect()]


def union(*lists: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The pairs of all lists in order, each once."""
    return list(dict.fromkeys(pair for own in lists for pair in own))


def document(entries: DataFrame, name: str, context: dict[str, Any] | None = None, notes: str = "") -> dict[str, Any]:
    """The manifest of some files as one document: entries come from gate.file_entries()."""
    if T.is_blank(name):
        raise ValueError("a manifest needs a name")
    rows = [r.asDict() for r in entries.orderBy("pos").collect()]
    if not rows:
        raise ValueError("a manifest needs a file")
    lacking = [r["path"] for r in rows if not r["exists"]]
    return {
        "name": name.strip(), "status": "WARN" if lacking else "PASS", "run_context": {k: (context or {}).get(k) for k in CONTEXT},
        "files": [{k: v for k, v in r.items() if k != "pos"} for r in rows], "missing_paths": lacking, "notes": notes,
    }


def run_document(entries: DataFrame, name: str, source: str, counts: dict[str, int], settings: dict[str, Any], warnings: list[str]) -> dict[str, Any]:
    """The manifest of a run over a dataset: what it read, with what settings, what it wrote, and whether all of that is there."""
    rows = [r.asDict() for r in entries.orderBy("pos").collect()]
    lacking = [r["path"] for r in rows if not r["exists"]]
    return {
        "run_name": name, "source": source, "counts": counts, "settings": settings, "files": {r["role"]: r["path"] for r in rows},
        "validation": {"status": "FAIL" if lacking else "PASS", "missing_outputs": lacking, "warnings": warnings},
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    """(status, missing_paths, file array) of manifest documents."""
    schema = "name string, status string, missing_paths array<string>, files array<struct<path:string,role:string,exists:boolean,record_count:bigint>>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def entries_of(manifests: DataFrame) -> DataFrame:
    """(path, role, record_count) of the files that manifests declare."""
    return manifests.select(F.explode("files").alias("f")).select("f.path", "f.role", "f.record_count")


def resolved(paths: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """paths(path), known(path) of files that are there -> path with `resolved`: as it stands, else beside the manifest, else below its folder, else as it stands."""
    base = folder.rstrip("/") + "/"
    name = F.element_at(F.split("path", "/"), -1)
    tries = [F.col("path")] + [F.when(~F.col("path").startswith("/"), F.concat(F.lit(base), c)) for c in (name, F.col("path"))]
    each = paths.distinct().select("path", F.posexplode(F.array(*tries)).alias("rank", "candidate"))
    met = each.join(known.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi")
    best = met.groupBy("path").agg(F.min_by("candidate", "rank").alias("__found"))
    return paths.join(best, "path", "left").select(*[paths[c] for c in paths.columns], F.coalesce("__found", "path").alias("resolved"))


def papers_inventory(papers: DataFrame) -> DataFrame:
    """One row a paper: its id, status, kind of source and the files it has."""
    return papers.select("paper_id", "arxiv_id", "parsing_status", "source_type", *(["files"] if "files" in papers.columns else []))


def missing_reviews(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths of review summaries that a manifest declares and that are there, those that are not)."""
    own = entries.where((F.col("role") == "manual_review_summary") & ~T.blank(F.col("path")))
    return own.where("exists").select("path"), own.where("NOT exists").select("path")


def with_pending(decision: Column, pending: Column) -> Column:
    """A gate that would accept asks for revision while declared reviews are pending."""
    return F.when((decision == "ACCEPT") & (pending > 0), "REVISE").otherwise(decision)
