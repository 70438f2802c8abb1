"""Validation and profiles of nested records; extraction models; prompts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The fields of an extraction and its degrees of confidence.
EXTRACTION = ["title", "field", "main_claim", "method", "limitations", "confidence"]
CONFIDENCE = ["low", "medium", "high"]
# The fields of metadata, and those that hold lists.
METADATA = ["arxiv_id", "title", "authors", "abstract", "categories", "published", "url"]
LISTS = ["authors", "categories"]
# The fields of a traceable record, by their dotted names.
TRACED = [
    *[f"source.{f}" for f in ("arxiv_id", "title", "authors", "categories", "published", "url")], *[f"extraction.{f}" for f in EXTRACTION],
    *[f"run.{f}" for f in ("run_id", "created_at", "backend", "model", "prompt_version", "prompt_template_sha256", "extraction_schema_version")],
]
# What the model without a model says.
FAKE = {
    "field": "High Energy Physics / detector simulation",
    "main_claim": "A parameterized method can reduce calorimeter simulation time within validated regions.",
    "method": "Parameterized shower shapes calibrated on reference detector samples.",
    "limitations": "The method is validated only in limited regions and requires further validation on full detector geometries.",
    "confidence": "medium",
}


def _field(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "variant")


def _kind(record: Column, name: str) -> Column:
    """STRING, ARRAY<...> and so on; null if the field is absent."""
    return F.schema_of_variant(_field(record, name))


def metadata_error(record: Column) -> Column:
    """The first rule that a metadata record breaks; null if it is valid. Further fields are allowed."""
    get = lambda f: F.try_variant_get(record, f"$.{f}", "string")
    lacking = F.array_compact(F.array(*[F.when(_field(record, f).isNull(), F.lit(f)) for f in METADATA]))
    rules = [F.when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ",")))]
    rules += [F.when(_kind(record, f) != "STRING", F.lit(f"not a string: {f}")) for f in sorted(set(METADATA) - set(LISTS))]
    rules += [F.when(~_kind(record, f).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(f"not a list of strings: {f}")) for f in LISTS]
    rules += [F.when(T.blank(get(f)), F.lit(f"blank: {f}")) for f in ("title", "abstract", "arxiv_id", "url")]
    return F.coalesce(*rules)


def extraction_error(record: Column, keys: Column) -> Column:
    """The first rule that an extraction breaks; keys: its own, as an array. No field beside the six is allowed."""
    six = F.array(*map(F.lit, EXTRACTION))
    get = lambda f: F.try_variant_get(record, f"$.{f}", "string")
    rules = [F.when(F.size(F.array_except(six, keys)) > 0, "missing field"), F.when(F.size(F.array_except(keys, six)) > 0, "unknown field")]
    rules += [F.when((_kind(record, f) != "STRING") | (F.coalesce(get(f), F.lit("")) == ""), F.lit(f"empty or no string: {f}")) for f in EXTRACTION]
    return F.coalesce(*rules, F.when(~get("confidence").isin(CONFIDENCE), "invalid confidence"))


def parse_model_json(text: Column) -> Column:
    return T.first_json(text)


def fake_extraction(title: Column) -> Column:
    return F.to_json(F.struct(title.alias("title"), *[F.lit(v).alias(k) for k, v in FAKE.items()]))


def traceable(title: Column, ident: Column, extraction: Column, run: Column) -> Column:
    """The triple of source, extraction and run."""
    return F.struct(F.struct(ident.alias("arxiv_id"), title.alias("title")).alias("source"), extraction.alias("extraction"), run.alias("run"))


def missing_fields(record: Column) -> Column:
    """The dotted names of a traceable record's fields that are absent, null, blank or an empty list."""

    def lacking(name: str) -> Column:
        value = F.try_variant_get(record, f"$.{name}", "variant")
        text = F.try_variant_get(record, f"$.{name}", "string")
        kind = F.schema_of_variant(value)
        return value.isNull() | (kind == "VOID") | ((kind == "STRING") & T.blank(text)) | (kind == "ARRAY<VOID>")

    return F.array_compact(F.array(*[F.when(F.coalesce(lacking(f), F.lit(True)), F.lit(f)) for f in TRACED]))


def findings(rows: DataFrame) -> DataFrame:
    """rows(line, record variant) -> (kind, line): each field that a record lacks, and each unknown confidence."""
    confidence = F.try_variant_get("record", "$.extraction.confidence", "string")
    odd = F.when(~T.blank(confidence) & ~confidence.isin(CONFIDENCE), F.lit("invalid confidence"))
    return rows.select(F.explode(F.array_compact(F.concat(missing_fields(F.col("record")), F.array(odd)))).alias("kind"), "line")


# What a formal summary counts records by.
GROUPS = {
    "confidence": "extraction.confidence",
    "backend": "run.backend",
    "model": "run.model",
    "prompt_version": "run.prompt_version",
    "prompt_template_sha256": "run.prompt_template_sha256",
    "extraction_schema_version": "run.extraction_schema_version",
}


def group_counts(rows: DataFrame) -> DataFrame:
    """rows(record variant) -> (field, value, records) for each field of GROUPS; what is absent or blank is <missing>."""
    get = lambda path: F.try_variant_get("record", f"$.{path}", "string")
    return histogram(rows, {name: F.when(~T.blank(get(path)), get(path)) for name, path in GROUPS.items()})


def finding_counts(found: DataFrame, shown: int = 10) -> DataFrame:
    """findings -> (kind, records, lines): of each kind how many records have it, and the first of them."""
    first = found.withColumn("__n", F.row_number().over(Window.partitionBy("kind").orderBy("line"))).where(F.col("__n") <= shown)
    lists = first.groupBy("kind").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return found.groupBy("kind").agg(F.count("*").alias("records")).join(lists, "kind")


def formal_summary(rows: DataFrame, require_source: bool = True) -> DataFrame:
    """One row: total, records_with_source, records with findings, status; without require_source only what is there counts."""
    found = findings(rows)
    found = found if require_source else found.where(~F.col("kind").startswith("source."))
    bad = found.agg(F.count_distinct("line").alias("records_with_findings"))
    source = F.coalesce(F.schema_of_variant(F.try_variant_get("record", "$.source", "variant")).startswith("OBJECT"), F.lit(False))
    out = rows.agg(F.count("*").alias("total"), F.count_if(source).alias("records_with_source")).crossJoin(F.broadcast(bad))
    return out.withColumn("status", F.when((F.col("total") > 0) & (F.col("records_with_findings") == 0), "PASS").otherwise("WARN"))


def summary_text(rows: DataFrame, path: str, require_source: bool = True, shown: int = 10) -> str:
    """A formal summary as lines to print: its tables are small, one row a value or a field."""
    total = formal_summary(rows, require_source).first()
    if not total["total"]:
        raise ValueError(f"no record in {path}")
    out = [f"JSONL file: {path}", f"Records: {total['total']}", f"Records with source block: {total['records_with_source']}", f"Source required: {str(require_source).lower()}", ""]
    counts = group_counts(rows).orderBy("field", "value").collect()
    for name in GROUPS:
        out += [f"{name}:", *[f"  {r['value']}: {r['records']}" for r in counts if r["field"] == name], ""]
    found = findings(rows)
    for r in finding_counts(found if require_source else found.where(~F.col("kind").startswith("source.")), shown).orderBy("kind").collect():
        out.append(f"{r['kind']}: {r['records']} record(s) [{', '.join(map(str, r['lines']))}{' ...' if r['records'] > shown else ''}]")
    return "\n".join([*out, f"Evaluation status: {total['status']}"])


class Model(Protocol):
    """Text in, text out."""

    def generate(self, prompt: str, temperature: float = 0.0) -> str: ...


def generator(factory, temperature: float = 0.0):
    """A vectorised function prompt -> struct(text, error); the model is made once for each task, errors stay with their row."""

    @F.pandas_udf("struct<text:string,error:string>")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for prompts in batches:
            out = []
            for prompt in prompts:
                try:
                    out.append((model.generate(prompt, temperature), None))
                except Exception as error:  # a failed call is a result, not the end of the job
                    out.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["text", "error"])

    return generate


PROMPT = "Read the title and abstract. Answer with one JSON object with the string fields " + ", ".join(EXTRACTION) + "; confidence is low, medium or high."


def prompt_sha256() -> str:
    """The digest of the prompt's template, by which runs tell prompts apart."""
    return hashlib.sha256(PROMPT.encode()).hexdigest()


def extraction_prompt(title: Column, abstract: Column) -> Column:
    return F.when(~T.blank(title) & ~T.blank(abstract), F.concat(F.lit(f"{PROMPT}\n\nTitle: "), T.trim(title), F.lit("\n\nAbstract: "), T.trim(abstract)))


def grounded_prompt(question: Column, hits: Column) -> Column:
    """hits: array of struct(rank, chunk_id, arxiv_id, title, section_heading, text), in order."""
    block = lambda h: F.concat(*[x for k in ("rank", "chunk_id", "arxiv_id", "title", "section_heading", "text") for x in (F.lit(f"{k}: "), F.coalesce(h[k].cast("string"), F.lit("")), F.lit("\n"))])
    context = F.when(F.size(hits) > 0, F.array_join(F.transform(hits, block), "\n")).otherwise("<NO_CONTEXT>")
    return F.concat(F.lit("Answer from the context alone, cite chunk ids, and say if it is not enough.\n\nQuestion:\n"), question, F.lit("\n\nContext:\n"), context)


def with_abstract(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """rows(arxiv_id, abstract, ...) with a blank abstract filled from metadata(pos, arxiv_id, abstract), the last of equal ids; else ''."""
    known = metadata.where(~T.blank(F.col("abstract")) & ~T.blank(F.col("arxiv_id"))).groupBy(F.col("arxiv_id").alias("__id")).agg(F.max_by("abstract", "pos").alias("__abstract"))
    joined = rows.join(known, F.col("arxiv_id") == F.col("__id"), "left")
    own = F.when(~T.blank(F.col("abstract")), F.col("abstract"))
    return joined.withColumn("abstract", F.coalesce(own, "__abstract", F.lit(""))).drop("__id", "__abstract")


def histogram(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, value, records): counts of each value of each field; null and blank as <missing>."""
    filled = [F.struct(F.lit(k).alias("field"), F.coalesce(F.nullif(v.cast("string"), F.lit("")), F.lit("<missing>")).alias("value")) for k, v in fields.items()]
    return rows.select(F.explode(F.array(*filled)).alias("s")).groupBy("s.field", "s.value").agg(F.count("*").alias("records"))


def zero_filled(rows: DataFrame, value: Column, labels: list[str], otherwise: str | None = None) -> DataFrame:
    """(label, records) with every label, also those without rows; other values count as otherwise."""
    known = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    seen = rows.select(F.when(value.isin(labels), value).otherwise(F.lit(otherwise)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return known.join(seen, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("records"))
