"""Reports as text: sheets for manual review, tables, previews; a row is rendered where it lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import gate


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


# The lines of a review sheet that reviewers tick and fill in.
TICKS = [
    "- [ ] `main_claim` is directly supported by the abstract.",
    "- [ ] `method` is directly supported by the abstract.",
    "- [ ] `limitations` are directly supported by the abstract.",
    "- [ ] No unsupported scientific claim was introduced.",
    "- [ ] The confidence label is plausible for this extraction.",
    "- [ ] Notes:",
]
UNDECIDED = "Review outcome: `pass | revise | reject | unclear`"


def review_section(index: Column, record: Column, abstract: Column | None = None, most: int = 4000) -> Column:
    """The sheet of one record (a variant), in the form that gate.review_records() reads.

    It shows where the record comes from, the abstract, cut to most characters, what the model said, and boxes to tick.
    """
    get = lambda *paths: F.coalesce(*[F.nullif(T.ws(F.try_variant_get(record, f"$.{p}", "string")), F.lit("")) for p in paths], F.lit("-"))
    body = T.truncate(T.trim(F.coalesce(*([] if abstract is None else [abstract]), F.try_variant_get(record, "$.source.abstract", "string"), F.lit(""))), most)
    parts = [
        "## Record ", _text(index), ": ", get("source.title", "extraction.title"), "\n\n- arXiv ID: `", get("source.arxiv_id"), "`\n- URL: ", get("source.url"),
        "\n- backend/model: `", get("run.backend"), "` / `", get("run.model"), "`\n- prompt version: `", get("run.prompt_version"), "`\n- extraction confidence: `", get("extraction.confidence"),
        "`\n\n### Abstract\n\n", F.coalesce(F.nullif(body, F.lit("")), F.lit("[the record has no abstract]")), "\n\n### Extracted fields\n\n",
        *[x for f in ("main_claim", "method", "limitations") for x in (f"- `{f}`: ", get(f"extraction.{f}"), "\n")], "\n### Checks\n\n" + "\n".join(TICKS) + f"\n\n{UNDECIDED}\n",
    ]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def cell(value: Column) -> Column:
    """A value of a table: one line, no bars; null as n/a."""
    return F.when(value.isNull(), "n/a").otherwise(F.replace(T.ws(value.cast("string")), F.lit("|"), F.lit("\\|")))


def table(rows: DataFrame, columns: list[str], order: list[str], title: str) -> DataFrame:
    """One row: a report with a table of summaries (rates by k, models, statuses, counts of errors), in order.

    For tables of bounded size, as these are, since all rows meet in one; null values are shown as n/a.
    """
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |"))
    out = gate.markdown(rows, line, order, title)
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    return out.select(F.concat(F.lit(f"# {title}\n\n{head}"), F.substr("report", F.lit(len(title) + 5), F.length("report"))).alias("report"))


def miss_lines(asked: DataFrame) -> DataFrame:
    """asked(q, question, retrieved, has_expected, hit, ...) -> (q, line): of each miss, what came first instead."""
    found = F.array_join(F.transform(F.slice("retrieved", 1, 5), lambda h: F.concat(h["citation_label"], F.lit(" "), h["chunk_id"])), ", ")
    return asked.where("has_expected AND NOT hit").select("q", F.concat(F.lit("- `"), _text(F.col("q")), F.lit("`: "), T.shorten(F.col("question")), F.lit("; retrieved "), F.coalesce(F.nullif(found, F.lit("")), F.lit("nothing"))).alias("line"))


def debug_sections(asked: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """asked(q, question, retrieved, has_expected, hit), diagnostics(q, expected_chunks, best_overlap, best_chunk) -> (q, section) of each miss."""
    met = asked.where("has_expected AND NOT hit").join(diagnostics, "q", "left")
    found = F.array_join(F.transform("retrieved", lambda h: F.concat(F.lit("- "), h["citation_label"], F.lit(" "), h["chunk_id"], F.lit(" "), F.format_string("%.6f", h["score"]))), "\n")
    parts = ["## ", _text(F.col("q")), "\n\nQuestion: ", T.ws(F.col("question")), "\nExpected chunks: ", _text(F.coalesce("expected_chunks", F.lit(0))), "\nMost terms in common: ", _text(F.coalesce("best_overlap", F.lit(0))), ", in ", F.coalesce(_text(F.col("best_chunk")), F.lit("none")), "\n\n", found, "\n"]
    return met.select("q", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("section"))


def answer_sheet(answered: DataFrame) -> DataFrame:
    """answered(q, question, retrieved, answer, citations) -> (q, section): what was retrieved, said and cited, with boxes to tick."""
    found = F.array_join(F.transform("retrieved", lambda h: F.concat(F.lit("- "), h["citation_label"], F.lit(" "), h["chunk_id"])), "\n")
    boxes = "\n".join(f"- [ ] {x}" for x in ("What was retrieved fits the question.", "The answer rests on it.", "Citations are right.", "Notes:"))
    parts = ["## ", _text(F.col("q")), "\n\nQuestion: ", T.ws(F.col("question")), "\n\n", F.coalesce(F.nullif(found, F.lit("")), F.lit("- nothing")), "\n\nAnswer: ", F.coalesce(F.nullif("answer", F.lit("")), F.lit("none")), "\nCited: ", F.coalesce(F.nullif(F.array_join("citations", ", "), F.lit("")), F.lit("nothing")), f"\n\n{boxes}\n"]
    return answered.select("q", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("section"))


def quality_report(validation: DataFrame, counts: DataFrame, title: str, most: int = 200) -> DataFrame:
    """One row of Markdown: validation (one row) as a list, counts(topic, name, number) as tables, of each topic the first names."""
    row = F.concat(*[x for c in validation.columns for x in (F.lit(f"- {c}: "), _text(F.col(c)), F.lit("\n"))])
    ranked = counts.withColumn("__n", F.row_number().over(Window.partitionBy("topic").orderBy("name"))).where(F.col("__n") <= most)
    line = F.concat(F.lit("| "), cell(F.col("topic")), F.lit(" | "), cell(F.col("name")), F.lit(" | "), _text(F.col("number")), F.lit(" |"))
    lists = ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic", "name", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return validation.select(row.alias("head")).crossJoin(F.broadcast(lists)).select(F.concat(F.lit(f"# {title}\n\n"), "head", F.lit("\n| topic | name | number |\n| --- | --- | --- |\n"), "lines", F.lit("\n")).alias("report"))


def record_lines(records: DataFrame, most: int = 100) -> DataFrame:
    """records(line, record variant) -> (line, preview): title, field, confidence and claim of each extraction."""
    get = lambda path: T.shorten(F.coalesce(F.try_variant_get("record", path, "string"), F.lit("<missing>")), most)
    parts = {"Title": "$.source.title", "Identifier": "$.source.arxiv_id", "Field": "$.extraction.field", "Confidence": "$.extraction.confidence", "Claim": "$.extraction.main_claim"}
    text = F.concat(F.lit("## Record "), _text(F.col("line")), *[F.concat(F.lit(f"\n{k}: "), get(v)) for k, v in parts.items()], F.lit("\n"))
    return records.select("line", text.alias("preview"))


def write(lines: DataFrame, column: str, order: list[str], path: str) -> str:
    """Reports of any size: sections in order of the given columns, in as many files as Spark makes partitions."""
    (lines.orderBy(*order) if order else lines).select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    return path
