"""Column functions over text, with the semantics of Unicode-aware string handling."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word and as a token.
WORD = r"(?U)\b[\w'-]+\b"
TOKEN_V0 = r"[a-zA-Z0-9_]+"
TOKEN_V1 = r"[a-zA-Z][a-zA-Z0-9_+-]*|[0-9]+(?:\.[0-9]+)?"
# The stop words of the second tokenizer.
STOP_WORDS = [
    "a", "about", "an", "and", "are", "as", "at", "be", "by", "can", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "paper",
    "selected", "that", "the", "their", "this", "to", "used", "what", "when", "where", "which", "with",
]
# Terms added to a query by the type of its question.
EXPANSIONS = {
    "method": ["method", "model", "approach", "architecture", "training"],
    "limitation": ["limitation", "validation", "caveat", "uncertainty", "future"],
    "dataset": ["dataset", "data", "sample", "benchmark", "events"],
    "metric": ["metric", "performance", "accuracy", "speed", "validation"],
    "result": ["result", "results", "performance", "comparison", "evaluation"],
}


def ws(text: Column) -> Column:
    """Runs of white space, of any script, as one space; none at the ends; null as empty."""
    return trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: str | None) -> bool:
    return not (text or "").strip()


def blank(text: Column) -> Column:
    return F.coalesce(trim(text) == "", F.lit(True))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """The pieces between white space; an empty array for a blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def tokens_v0(text: Column) -> Column:
    """Matched first and lower-cased second: letters whose small form is ASCII don't slip in."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_V0), F.lit(0)), lambda t: F.lower(t))


def tokens_v1(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_V1), F.lit(0))
    clean = F.transform(found, lambda t: F.btrim(F.lower(t), F.lit("+-_")))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(clean, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def query_terms(question: Column, kind: Column, keywords: Column) -> Column:
    """Distinct terms of a question, then of its type's expansion as they stand, then of its keywords."""
    known = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    empty = F.array().cast("array<string>")
    extra = F.coalesce(F.try_element_at(known, F.coalesce(kind, F.lit(""))), empty)
    more = F.flatten(F.transform(F.coalesce(keywords, empty), tokens_v1))
    return F.array_distinct(F.concat(tokens_v1(question), extra, more))


def slug(text: Column, otherwise: str | None = None) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one underscore, none at the ends."""
    out = F.btrim(F.regexp_replace(F.lower(trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))
    return out if otherwise is None else F.coalesce(F.nullif(out, F.lit("")), F.lit(otherwise))


def normalize_section(heading: Column) -> Column:
    return slug(heading, "unknown")


def chunk_id_v1(paper: Column, index: Column) -> Column:
    name = F.when(blank(paper), "unknown_paper").otherwise(trim(paper))
    return F.concat(name, F.lit("::chunk_v1::"), F.format_string("%04d", index))


def normalized_text(text: Column) -> Column:
    return ws(F.lower(F.coalesce(text, F.lit(""))))


def paper_key(identifier: Column) -> Column:
    """An identifier without its prefix, address, extension and slashes; null if nothing is left."""
    out = F.regexp_replace(trim(identifier), "^(?:arXiv|arxiv):", "")
    for mark in ("/abs/", "/pdf/"):
        out = F.substring_index(out, mark, -1)
    out = F.btrim(F.regexp_replace(trim(out), r"\.pdf$", ""), F.lit("/"))
    return F.nullif(out, F.lit(""))


def safe_paper_id(identifier: Column) -> Column:
    return slug(paper_key(identifier))


def model_slug(backend: Column, model: Column) -> Column:
    return F.when(backend == "fake", F.lit("fake")).otherwise(F.translate(model, ":/.", "___"))


def truncate(text: Column, most: int, mark: str = "\n\n[abstract truncated]") -> Column:
    if most < 100:
        raise ValueError("a text is cut to 100 characters at least")
    cut = F.regexp_replace(F.substring(text, 1, most - 24), r"(?U)\s+$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit(mark)))


def shorten(text: Column, most: int = 90) -> Column:
    flat = ws(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most - 3), r"\s+$", ""), F.lit("...")))


def preview(text: Column, most: int = 280) -> Column:
    return F.substring(ws(text), 1, most)


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def decode(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def as_list(value: Column) -> Column:
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def strip_fences(text: Column) -> Column:
    """A leading code fence line and a closing one are cut."""
    return trim(F.regexp_replace(F.regexp_replace(trim(text), r"^```[^\n]*\n", ""), r"\n?```\s*$", ""))


def first_object(text: Column) -> Column:
    """A text from its first opening brace to the one that closes it; null if there is none, or none that does.

    Braces in strings don't count. Escaped signs are covered first, so that a string is what stands between two quotes;
    one pass over strings, braces and the rest then follows the depth.
    """
    text = F.coalesce(text, F.lit(""))
    body = F.when(F.instr(text, "{") > 0, F.substr(text, F.instr(text, "{"), F.length(text)))
    covered = F.replace(F.replace(body, F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))
    pieces = F.regexp_extract_all(covered, F.lit(r'"[^"]*(?:"|\z)|[{}]|[^"{}]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(at: Column, piece: Column) -> Column:
        depth = at.depth + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.when(at.done, at).otherwise(F.struct(depth.alias("depth"), (at.size + F.length(piece)).alias("size"), (depth == 0).alias("done")))

    size = F.aggregate(pieces, start, step, lambda at: F.when(at.done, at.size))
    return F.when(size.isNotNull(), F.substr(body, F.lit(1), size))


def last_keys(text: Column) -> Column:
    """JSON in which a key that occurs twice in an object keeps its last value; null if it is no JSON."""
    def one(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(json.loads(value))
        except (ValueError, RecursionError):
            return None

    def run(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def first_json(text: Column) -> Column:
    """The first JSON object in a text as a variant; null if there is none. Of equal keys the last counts.

    Variants refuse equal keys, so what can't be parsed as it stands is written anew with its last ones; only such rows have anything
    sent to Python.
    """
    cut = first_object(strip_fences(F.coalesce(text, F.lit(""))))
    direct = F.try_parse_json(cut)
    return F.coalesce(direct, F.try_parse_json(last_keys(F.when(direct.isNull(), cut))))


def object_keys(record: Column) -> Column:
    """The keys of a variant that is an object."""
    return F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))
