"""Sections, equations and plain text of marked-up documents, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import pinned

# The commands that open a section, display an equation or include a file.
SECTION = r"\\(section|subsection|subsubsection)\*?\{([^{}]+)\}"
EQUATION = r"(?s)\\begin\{(equation\*?|align\*?|gather\*?)\}.*?\\end\{\1\}|\\\[.*?\\\]|\$\$.*?\$\$"
INPUT = r"\\(?:input|include)\{([^{}]+)\}"
# What is cleaned away, in this order.
CLEAN = [
    (r"\\begin\{document\}|\\end\{document\}", " "),
    (r"\\(?:title|author|date)\{[^{}]*\}", " "),
    (r"\\maketitle", " "),
    (r"\\label\{[^{}]*\}", " "),
    (r"\\(?:cite|ref|eqref)\{[^{}]*\}", " [REF] "),
    (r"\\(?:emph|textbf|textit|mathrm|mathbf)\{([^{}]*)\}", "$1"),
    (r"\$(.*?)\$", "$1"),
    (r"\\begin\{[^{}]+\}|\\end\{[^{}]+\}", " "),
    (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " "),
    ("~", " "),
    (r"[{}]", " "),
]
CONTEXT = 300


def strip_comments(text: Column) -> Column:
    """Each line up to its first percent sign that no backslash precedes."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return F.regexp_replace(lines, r"(?m)(?<!\\)%.*$", "")


def clean(text: Column) -> Column:
    for pattern, by in CLEAN:
        text = F.regexp_replace(text, pattern, by)
    return T.ws(text)


def body(text: Column) -> Column:
    """What stands between begin and end of the document, if they do."""
    out = F.when(text.contains("\\begin{document}"), F.regexp_replace(text, r"(?s)^.*?\\begin\{document\}", "")).otherwise(text)
    return F.regexp_replace(out, r"(?s)\\end\{document\}.*$", "")


def with_equations(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with equations, an array of (equation_no, equation_id, raw_latex, context_before, context_after):
    one for each display equation, with 300 characters on either side."""
    rows = pinned(rows, __b=F.split("text", EQUATION, -1), __f=F.regexp_extract_all("text", F.lit(EQUATION), F.lit(0)))
    lengths = F.zip_with("__b", "__f", lambda b, f: F.length(b) + F.coalesce(F.length(f), F.lit(0)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    step = lambda acc, n: F.struct((acc.at + n).alias("at"), F.concat(acc.ends, F.array(acc.at + n)).alias("ends"))
    rows = pinned(rows, __e=F.aggregate(lengths, begin, step, lambda acc: acc.ends))

    def one(raw: Column, no: Column) -> Column:
        end = F.element_at("__e", no + 1)
        start = end - F.length(raw)
        first = F.greatest(start - CONTEXT, F.lit(0))
        before, after = F.substr("text", first + 1, start - first), F.substr("text", end + 1, F.lit(CONTEXT))
        return F.struct(
            (no + 1).cast("long").alias("equation_no"), F.format_string("eq_%03d", no + 1).alias("equation_id"), T.trim(raw).alias("raw_latex"), clean(before).alias("context_before"), clean(after).alias("context_after"),
        )

    return pinned(rows, equations=F.transform("__f", one)).drop("__b", "__f", "__e")


def equations(sources: DataFrame) -> DataFrame:
    """sources(paper_id, text) -> one row per display equation, as with_equations() gives it."""
    return with_equations(sources.select("paper_id", "text")).select("paper_id", F.inline("equations"))


def with_placeholders(text: Column) -> Column:
    """Each display equation replaced by its numbered placeholder."""
    mark = lambda i: F.concat(F.lit(" [EQUATION_"), F.format_string("%03d", i), F.lit("] "))
    return F.array_join(F.transform(F.split(text, EQUATION, -1), lambda piece, i: F.when(i > 0, F.concat(mark(i), piece)).otherwise(piece)), "")


def with_sections(rows: DataFrame, source_type: str = "latex_source") -> DataFrame:
    """rows(text, ...) with sections, an array of (section_no, section_id, level, heading, text up to the next heading, word_count, source_type).

    Text before the first heading is left out; a document without headings is one section, if it has text.
    """
    rows = pinned(rows, __t=body(F.col("text")))
    rows = pinned(rows, __b=F.split("__t", SECTION, -1), **{n: F.regexp_extract_all("__t", F.lit(SECTION), F.lit(g)) for n, g in (("__k", 1), ("__h", 2))})
    one = F.array(F.struct(F.lit("section").alias("kind"), F.lit("Full text").alias("heading"), F.col("__t").alias("part")))
    many = F.transform("__k", lambda kind, i: F.struct(kind.alias("kind"), F.element_at("__h", i + 1).alias("heading"), F.element_at("__b", i + 2).alias("part")))
    rows = pinned(rows, __c=F.transform(F.when(F.size("__k") == 0, one).otherwise(many), lambda s: F.struct(s.kind.alias("kind"), clean(s.heading).alias("heading"), clean(s.part).alias("text"))))
    rows = rows.withColumn("__c", F.filter("__c", lambda s: (F.size("__k") > 0) | (s.text != "")))

    def told(s: Column, no: Column) -> Column:
        level = F.when(s.kind == "section", 1).when(s.kind == "subsection", 2).otherwise(3).cast("long")
        heading = F.coalesce(F.nullif(s.heading, F.lit("")), F.format_string("Section %d", no + 1))
        return F.struct(
            (no + 1).cast("long").alias("section_no"), F.format_string("sec_%03d", no + 1).alias("section_id"), level.alias("level"), heading.alias("heading"), s.text.alias("text"),
            T.word_count(s.text).alias("word_count"), F.lit(source_type).alias("source_type"),
        )

    return pinned(rows, sections=F.transform("__c", told)).drop("__t", "__b", "__k", "__h", "__c")


def sections(sources: DataFrame, source_type: str = "latex_source") -> DataFrame:
    """sources(paper_id, text) -> one row per heading, as with_sections() gives it."""
    return with_sections(sources.select("paper_id", "text"), source_type).select("paper_id", F.inline("sections"))


def equation_sections(found: DataFrame, parts: DataFrame) -> DataFrame:
    """equations with the first section whose text has their placeholder."""
    inside = parts.select("paper_id", "section_no", "section_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[EQUATION_(\d+)\]"), F.lit(1)))).alias("equation_no")).withColumn("equation_no", F.col("equation_no").cast("long"))
    first = inside.groupBy("paper_id", "equation_no").agg(F.min_by("section_id", "section_no").alias("section_id"))
    return found.join(first, ["paper_id", "equation_no"], "left")


# What marks a main file, in points beside its size in bytes, and the names that do.
MAIN_POINTS = [("\\documentclass", 1_000_000), ("\\begin{document}", 500_000)]
MAIN_NAMES, NAME_POINTS = ["main", "paper", "ms", "article"], 25_000


def main_file(files: DataFrame) -> DataFrame:
    """files(paper_id, path, text) -> the main file of each paper, among those that end in .tex."""
    stem = F.lower(F.regexp_extract("path", r"([^/]+)\.tex$", 1))
    points = [F.when(F.col("text").contains(mark), n).otherwise(0) for mark, n in MAIN_POINTS] + [F.when(stem.isin(MAIN_NAMES), NAME_POINTS).otherwise(0)]
    score = F.struct(sum(points, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), F.coalesce(F.length("text"), F.lit(0)), "path")
    own = files.where(F.col("path").endswith(".tex"))
    return own.groupBy("paper_id").agg(F.max_by(F.struct("path", "text"), score).alias("f")).select("paper_id", "f.*")


def html_sections(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> one row per heading h1 to h6: level, heading, text up to the next one."""
    heading = r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"
    rows = pages.select("page_id", F.split("html", heading, -1).alias("between"), F.regexp_extract_all("html", F.lit(heading), F.lit(1)).alias("levels"), F.regexp_extract_all("html", F.lit(heading), F.lit(2)).alias("headings"))
    each = F.transform(F.sequence(F.lit(1), F.size("levels")), lambda i: F.struct(F.element_at("levels", i).cast("long").alias("level"), F.element_at("headings", i).alias("heading"), F.element_at("between", i + 1).alias("part")))
    rows = rows.where(F.size("levels") > 0).select("page_id", F.posexplode(each).alias("no", "s"))
    return rows.select("page_id", (F.col("no") + 1).cast("long").alias("section_no"), "s.level", html_text(F.col("s.heading")).alias("heading"), html_text(F.col("s.part")).alias("text"))


def html_text(html: Column) -> Column:
    """Scripts, styles, comments and tags away, white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return T.ws(F.regexp_replace(out, r"(?s)<[^>]*>", " "))


def lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one row per line, with the offset where it starts and where the next begins."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    w = Window.partitionBy("doc_id").orderBy("no")
    start = F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("line") - 1
    rows = rows.withColumn("start", start.cast("long"))
    return rows.withColumn("next_start", F.lead("start").over(w)).withColumn("no", (F.col("no") + 1).cast("long"))
