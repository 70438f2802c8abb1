"""Audit and normalisation of chunks: flags, orphans, duplicates, stable ids, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import spread

# Source types that the audit and the validator allow, and the bounds of a chunk's length.
AUDIT_TYPES = ["abstract", "section", "equation_context", "table_context", "unknown"]
VALID_TYPES = ["section", "abstract", "equation_context"]
VERY_SHORT, VERY_LONG = 80, 2500
#: Positions of one slice of a group that is numbered in pieces.
SPAN = 1 << 16
# The fields that a chunk must have.
REQUIRED = ["chunk_id", "paper_id", "arxiv_id", "title", "source_type", "section_id", "section_heading", "text", "word_count", "metadata"]
REQUIRED_METADATA = ["domain", "source_pilot", "paper_dir", "source_file", "parsing_status", "source_type_original"]


def missing(value: Column, kind: str) -> Column:
    """Null, a blank string, an empty map; an empty list or zero isn't missing."""
    if kind == "string":
        return T.blank(value)
    return value.isNull() | (F.size(value) == 0) if kind.startswith("map") else value.isNull()


def missing_or_empty_list(value: Column, kind: str) -> Column:
    """Null, a blank string, an empty list; an empty map isn't missing."""
    if kind == "string":
        return T.blank(value)
    return value.isNull() | (F.size(value) == 0) if kind.startswith("array") else value.isNull()


def with_flags(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """chunks(paper_id, arxiv_id, title, section, source_type, text, ...) with quality_flags, an ordered array.

    Orphans come from a left join with the distinct paper ids, duplicates from counts of the text's digest that
    join back, those above one alone, so that neither a hot paper nor a text with many copies collects its rows in one task.
    """
    ids = papers.select(F.col("paper_id").alias("__paper")).where("__paper IS NOT NULL").distinct().withColumn("__known", F.lit(True))
    rows = spread(chunks).withColumn("__norm", T.normalized_text(F.col("text"))).withColumn("__digest", F.sha2("__norm", 256)).drop("__norm")
    counts = rows.groupBy("__digest").agg(F.count("*").alias("__copies")).where("__copies > 1")
    rows = rows.join(ids, T.trim(F.col("paper_id")) == F.col("__paper"), "left").join(counts, "__digest", "left")
    text, filled = F.col("text"), ~T.blank(F.col("text"))
    tests = [
        (~filled, "empty_text"), (T.blank(F.col("paper_id")), "missing_paper_id"), (T.blank(F.col("arxiv_id")), "missing_arxiv_id"),
        (T.blank(F.col("title")), "missing_title"), (T.blank(F.col("section")), "missing_section"),
        (~F.coalesce(T.trim(F.col("source_type")), F.lit("")).isin(AUDIT_TYPES), "unknown_source_type"),
        (filled & (F.length(text) < VERY_SHORT), "very_short_text"), (F.length(text) > VERY_LONG, "very_long_text"),
        (~T.blank(F.col("paper_id")) & F.col("__known").isNull(), "orphan_chunk"), (filled & F.col("__copies").isNotNull(), "duplicate_text_candidate"),
    ]
    flags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))
    return rows.withColumn("quality_flags", flags).drop("__digest", "__copies", "__paper", "__known")


def duplicate_texts(rows: DataFrame, ident: str) -> DataFrame:
    """(digest, copies, first_id) of texts that several rows have, white space and case apart."""
    digest = F.md5(T.normalized_text(F.col("text")).cast("binary")).alias("digest")
    return rows.groupBy(digest).agg(F.count("*").alias("copies"), F.min(ident).alias("first_id")).where("copies > 1")


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("chunks"))


#: What an audit counts chunks by, and the columns for it; the last is the empty grouping.
DIMENSIONS = {"paper": "paper_id", "section": "section", "source_type": "source_type", "flag": "__flag", "all": None}


def corpus_audit(flagged: DataFrame) -> DataFrame:
    """chunks with quality_flags -> (dimension, value, chunks, least, mean, median, most): counts and lengths in characters by paper,
    section, source type and flag, and of all, in one pass of grouping sets.

    A chunk is one row beside a row for each of its flags; the latter count by flag alone. Medians are exact, from counts
    of each length, so a group of any size takes no more memory than it has lengths. Blank values are <missing>; without
    chunks there is no row.
    """
    named = lambda c: F.when(T.blank(F.col(c).cast("string")), "<missing>").otherwise(F.col(c).cast("string")).alias(c)
    rows = flagged.select(*[named(c) for c in DIMENSIONS.values() if c and c != "__flag"], F.coalesce(F.length("text"), F.lit(0)).alias("__size"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "quality_flags")).alias("__flag"))
    keys = [c for c in DIMENSIONS.values() if c]
    whole = F.when(F.col("__whole"), F.col("__size"))
    flag = F.when(~F.col("__whole"), F.col("__size"))
    rows = rows.withColumn("__whole", F.col("__flag").isNull())
    told = lambda size, n: [F.count(size).alias(f"chunks{n}"), F.min(size).alias(f"least{n}"), F.avg(size).alias(f"mean{n}"), F.median(size).alias(f"median{n}"), F.max(size).alias(f"most{n}")]
    got = rows.groupingSets([[F.col(c)] if c else [] for c in DIMENSIONS.values()], *keys).agg(F.grouping_id().alias("__set"), *told(whole, 0), *told(flag, 1))
    # grouping_id has a bit for each key that a set leaves out, the first key's the highest
    sets = {name: sum(1 << (len(keys) - 1 - k) for k, key in enumerate(keys) if key != c) for name, c in DIMENSIONS.items()}
    dimension = F.coalesce(*[F.when(F.col("__set") == number, name) for name, number in sets.items()])
    pick = lambda c, kind: F.when(F.col("__set") == sets["flag"], F.col(f"{c}1")).otherwise(F.col(f"{c}0")).cast(kind).alias(c)
    out = got.select(dimension.alias("dimension"), F.coalesce(*keys, F.lit("")).alias("value"), pick("chunks", "long"), pick("least", "long"), F.round(pick("mean", "double"), 4).alias("mean"), pick("median", "double"), pick("most", "long"))
    return out.where("chunks > 0")


def last_by(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The last row of each key, as when a dictionary is filled in order."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), pos).alias("__row"))
    return newest.select("__row.*")


def resolve_papers(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """chunks with resolved_paper_id and paper_title: by paper_id, else by arxiv_id; the last of duplicate papers wins."""
    by_id = last_by(papers.select("paper_id", "title", "pos"), "paper_id").select(F.col("paper_id").alias("__p"), F.col("title").alias("__pt"))
    by_arxiv = last_by(papers.select("arxiv_id", "paper_id", "title", "pos"), "arxiv_id").select(F.col("arxiv_id").alias("__a"), F.col("paper_id").alias("__ap"), F.col("title").alias("__at"))
    out = chunks.join(by_id, F.col("paper_id") == F.col("__p"), "left").join(by_arxiv, F.col("arxiv_id") == F.col("__a"), "left")
    out = out.withColumn("resolved_paper_id", F.coalesce("__p", "__ap", "paper_id")).withColumn("paper_title", F.coalesce("__pt", "__at"))
    return out.drop("__p", "__pt", "__a", "__ap", "__at")


def numbered(rows: DataFrame, by: str, pos: str = "pos", span: int = SPAN) -> DataFrame:
    """rows with __n, the running number from 1 of each row of its group, in order of pos, a whole number.

    Rows are numbered within slices of span positions, and the small table of slices says how many rows lie before
    each: a group with a third of all rows is numbered by as many tasks as it has slices.
    """
    sliced = rows.withColumn("__slice", F.floor(F.col(pos) / span))
    held = sliced.groupBy(by, "__slice").agg(F.count("*").alias("__count"))
    before = F.sum("__count").over(Window.partitionBy(by).orderBy("__slice")) - F.col("__count")
    held = held.select(F.col(by).alias("__by"), F.col("__slice").alias("__at"), before.alias("__before"))
    own = sliced.withColumn("__n", F.row_number().over(Window.partitionBy(by, "__slice").orderBy(pos)))
    joined = own.join(held, F.col(by).eqNullSafe(F.col("__by")) & F.col("__slice").eqNullSafe(F.col("__at")))
    return joined.withColumn("__n", (F.col("__n") + F.col("__before")).cast("int")).drop("__slice", "__by", "__at", "__before")


def with_v1_ids(chunks: DataFrame) -> DataFrame:
    """chunks(resolved_paper_id, section, pos, ...) with chunk_id_v1 (running per paper) and section_normalized."""
    out = numbered(chunks, "resolved_paper_id").withColumn("chunk_id_v1", T.chunk_id_v1(F.col("resolved_paper_id"), F.col("__n"))).drop("__n")
    return out.withColumn("section_normalized", T.normalize_section(F.col("section")))


def attach_equations(chunks: DataFrame, equations: DataFrame) -> DataFrame:
    """chunks with equation_ids, those of their resolved paper and section, in order; else an empty array."""
    grouped = equations.groupBy(F.col("paper_id").alias("__p"), F.col("section_id").alias("__s")).agg(F.array_sort(F.collect_list(F.struct("pos", "equation_id"))).alias("__e"))
    joined = chunks.join(grouped, (F.col("resolved_paper_id") == F.col("__p")) & (F.col("section_id") == F.col("__s")), "left")
    ids = F.coalesce(F.transform("__e", lambda e: e["equation_id"]), F.array().cast("array<string>"))
    return joined.withColumn("equation_ids", ids).drop("__p", "__s", "__e")


def missing_of(chunks: DataFrame) -> Column:
    """The names of the fields that a chunk must have and lacks, those of its metadata by dotted names; a null word_count is named twice.

    A column that the table hasn't is missing everywhere. Metadata may be a map or a struct.
    """
    kinds = dict(chunks.dtypes)
    here = lambda f: missing(F.col(f), kinds[f]) if f in kinds else F.lit(True)
    names = [F.when(here(f), F.lit(f)) for f in REQUIRED] + [F.when(F.col("word_count").isNull() if "word_count" in kinds else F.lit(True), F.lit("word_count"))]
    if kinds.get("metadata", "").startswith("map"):
        inner = {f: T.blank(F.try_element_at("metadata", F.lit(f))) for f in REQUIRED_METADATA}
    elif kinds.get("metadata", "").startswith("struct"):
        own = chunks.schema["metadata"].dataType.fieldNames()
        inner = {f: T.blank(F.col(f"metadata.{f}").cast("string")) if f in own else F.lit(True) for f in REQUIRED_METADATA}
    else:
        inner = {}
    names += [F.when(F.col("metadata").isNotNull() & test, F.lit(f"metadata.{f}")) for f, test in inner.items()]
    return F.array_compact(F.array(*names))


def missing_counts(chunks: DataFrame) -> DataFrame:
    """(field, chunks): how often each required field is missing."""
    return chunks.select(F.explode(missing_of(chunks)).alias("field")).groupBy("field").agg(F.count("*").alias("chunks"))


def with_columns(chunks: DataFrame) -> DataFrame:
    """chunks with nulls in the place of columns that it hasn't."""
    lacking = [f for f in REQUIRED if f not in chunks.columns and f != "metadata"]
    return chunks.withColumns({f: F.lit(None).cast("long" if f == "word_count" else "string") for f in lacking})


def validate_chunks(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """One row: counts of missing fields, duplicate ids, orphans, empties, papers without chunks, statistics, status.

    A count beside the tolerance, or a source type of another kind, is a warning only. Statistics are zero without counts.
    """
    chunks = with_columns(chunks.withColumn("__missing", F.size(missing_of(chunks)).cast("long")))
    actual = T.word_count(F.col("text"))
    off = F.abs(F.col("word_count") - actual) > F.greatest(F.lit(3), F.floor(actual * 0.2))
    ids = papers.select(F.col("paper_id").alias("__p")).where("__p IS NOT NULL AND __p <> ''").distinct()
    joined = chunks.join(ids, F.coalesce("paper_id", F.lit("")) == F.col("__p"), "left")
    main = joined.agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum("__missing"), F.lit(0)).alias("missing_fields"), F.count_if(F.col("__p").isNull()).alias("orphan_chunks"),
        F.count_if(T.blank(F.col("text"))).alias("empty_chunks"), F.count_if(~F.coalesce("source_type", F.lit("")).isin(VALID_TYPES)).alias("invalid_types"),
        F.count_if(off).alias("word_count_mismatch"), *[F.coalesce(f("word_count"), F.lit(0)).alias(n) for n, f in (("min_words", F.min), ("median_words", F.median), ("max_words", F.max))],
    )
    doubled = duplicate_ids(chunks).agg(F.count("*").alias("duplicate_ids"))
    lonely = without_chunks(chunks, papers).agg(F.count("*").alias("papers_without_chunks"))
    out = main.crossJoin(F.broadcast(doubled)).crossJoin(F.broadcast(lonely))
    bad = (F.col("orphan_chunks") > 0) | (F.col("empty_chunks") > 0) | (F.col("duplicate_ids") > 0) | (F.col("missing_fields") > 0)
    warn = (F.col("papers_without_chunks") > 0) | (F.col("invalid_types") > 0) | (F.col("word_count_mismatch") > 0)
    return out.withColumn("status", F.when(bad, "FAIL").when(warn, "REVISE").otherwise("PASS"))


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """(chunk_id, chunks) of ids that several chunks have."""
    return chunks.where("chunk_id <> ''").groupBy("chunk_id").agg(F.count("*").alias("chunks")).where("chunks > 1")


def without_chunks(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    return papers.select("paper_id").where("paper_id <> ''").distinct().join(chunks.select("paper_id"), "paper_id", "left_anti")


def chunk_warnings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, warning) of each chunk whose source type isn't allowed."""
    kind = F.coalesce(F.nullif("source_type", F.lit("")), F.lit("<missing>"))
    return chunks.where(~kind.isin(VALID_TYPES)).select(F.coalesce(F.nullif("chunk_id", F.lit("")), F.lit("<missing>")).alias("chunk_id"), F.concat(F.lit("invalid source_type "), kind).alias("warning"))


def quality_counts(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """(topic, name, number): chunks of each paper and source type, missing fields, papers of each status, in one table."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("<missing>"))
    per_paper = chunks.where("paper_id <> ''").groupBy(F.lit("chunks_per_paper").alias("topic"), F.col("paper_id").alias("name")).agg(F.count("*").alias("number"))
    types = chunks.groupBy(F.lit("source_type_counts").alias("topic"), named("source_type").alias("name")).agg(F.count("*").alias("number"))
    lacking = missing_counts(chunks).select(F.lit("missing_field_counts").alias("topic"), F.col("field").alias("name"), F.col("chunks").alias("number"))
    states = papers.groupBy(F.lit("parsing_status_counts").alias("topic"), named("parsing_status").alias("name")).agg(F.count("*").alias("number"))
    return per_paper.union(types).union(lacking).union(states)


def quality_recommendation(status: Column) -> Column:
    return F.when(status == "FAIL", "repair the chunks before anything is retrieved").when(status == "REVISE", "look at warnings and at papers without chunks").otherwise("look at some chunks by hand, then go on")
