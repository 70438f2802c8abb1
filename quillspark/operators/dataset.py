"""Datasets of papers: parsing of sources, tables of chunks and equations, their second form, summaries of parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import readers
from . import audit, chunking, markup, records
from .shared import frozen, pinned

# The kinds of errors in parsing, and the statuses whose papers go into a dataset.
ERRORS = [
    "metadata_error", "source_download_error", "source_unavailable", "archive_extract_error", "latex_main_file_not_found", "latex_flatten_error",
    "section_extraction_weak", "equation_extraction_weak", "plain_text_empty", "chunk_generation_empty", "pdf_fallback_skipped", "pdf_parse_error", "unknown_error",
]
INCLUDED = ["success", "partial"]


def inclusions(files: DataFrame) -> DataFrame:
    """files(paper_id, path, text) -> (paper_id, path, nth, name, target): the nth inclusion of a file, and the file that it names or null.

    Names are taken from the main file's folder; a name without .tex may lack it.
    """
    main = markup.main_file(files).select("paper_id", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("root"))
    named = files.select("paper_id", "path", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(markup.INPUT), F.lit(1))).alias("nth", "name"))
    named = named.join(main, "paper_id")
    full = F.concat("root", F.regexp_replace(T.trim(F.col("name")), r"(^|/)(?:\./)+", "$1"))
    ways = named.select("paper_id", "path", "nth", "name", F.posexplode(F.array(full, F.concat(full, F.lit(".tex")))).alias("way", "target"))
    held = files.select("paper_id", F.col("path").alias("target"), F.lit(True).alias("held")).distinct()
    ways = ways.join(held, ["paper_id", "target"], "left")
    return ways.groupBy("paper_id", "path", "nth", "name").agg(F.min_by("target", F.when(F.col("held"), F.col("way"))).alias("target"))


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges (paper_id, path, nth, target), roots (paper_id, path) -> (paper_id, path, place): each file that is reached, at the
    place where reading in order meets it first.

    A place lists, from the root on, how many pieces of text and inclusions stand before; places compare as arrays do. Each round
    follows the inclusions of files that were reached at an earlier place than before, so cycles end by themselves, and a
    paper takes as many rounds as its inclusions are deep, and only by exception a few more.
    """
    best = frozen(roots.select("paper_id", "path", F.array().cast("array<int>").alias("place")))
    new, edges = best, edges.where("target IS NOT NULL").select("paper_id", "path", "nth", "target")
    while True:
        step = new.join(edges, ["paper_id", "path"]).select("paper_id", F.col("target").alias("path"), F.concat("place", F.array((F.col("nth") * 2 + 1).cast("int"))).alias("place"))
        step = step.groupBy("paper_id", "path").agg(F.min("place").alias("at"))
        new = frozen(step.join(best, ["paper_id", "path"], "left").where("place IS NULL OR at < place").select("paper_id", "path", F.col("at").alias("place")))
        if new.isEmpty():
            return best
        best = frozen(best.join(new.select("paper_id", "path"), ["paper_id", "path"], "left_anti").union(new))


def flattened(files: DataFrame) -> DataFrame:
    """files(paper_id, path, text) -> (paper_id, path, text): the main file with the files it includes, each once, where it is met first.

    Files are nodes and inclusions edges of a graph that is followed by joins (see reached()). A file's pieces between its
    inclusions then take the odd places around theirs, and a paper's text is its pieces in order. An inclusion that names no
    file becomes a comment; one of a file that stands elsewhere leaves two line ends.
    """
    edges = frozen(inclusions(files))
    mains = markup.main_file(files).select("paper_id", "path")
    places = reached(edges, mains)
    lost = edges.groupBy("paper_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("nth", F.when(F.col("target").isNull(), F.col("name")).alias("name")))).alias("lost"))
    rows = files.join(places, ["paper_id", "path"]).join(lost, ["paper_id", "path"], "left")
    pieces = rows.select("paper_id", "place", "lost", F.posexplode(F.split(F.coalesce("text", F.lit("")), markup.INPUT, -1)).alias("k", "piece"))
    held = F.map_contains_key("lost", F.col("k"))
    name = F.try_element_at("lost", F.col("k"))
    after = F.when(~F.coalesce(held, F.lit(False)), "").when(name.isNull(), "\n").otherwise(F.concat(F.lit("\n% not found: "), name))
    text = F.concat(F.when(F.col("k") > 0, "\n").otherwise(""), "piece", after)
    pieces = pieces.select("paper_id", F.struct(F.concat("place", F.array(F.col("k") * 2)).alias("place"), text.alias("text")).alias("p"))
    texts = pieces.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("p")).getField("text"), "").alias("text"))
    return mains.join(texts, "paper_id").select("paper_id", "path", "text")


def nested(sources: DataFrame) -> DataFrame:
    """sources(paper_id, text) -> one row a paper: sections, equations and chunks as arrays, counts, errors, warnings, parsing_status.

    One pass without an exchange: everything about a paper follows from its text. An error (no text, no chunks) makes a
    paper failed, or partial if there are text and chunks all the same; a warning (no sections, no equations) makes it
    partial. The text is that of headings and sections together.
    """
    rows = markup.with_equations(pinned(sources.select("paper_id", "text"), text=markup.strip_comments(F.col("text"))))
    rows = pinned(rows, text=markup.with_placeholders(F.col("text")))
    rows = chunking.with_windows(markup.with_sections(rows))
    marks = F.transform("sections", lambda s: F.transform(F.regexp_extract_all(s.text, F.lit(r"\[EQUATION_(\d+)\]"), F.lit(1)), lambda n: F.struct(n.cast("long").alias("no"), s.section_id.alias("section_id"))))
    rows = pinned(rows, __m=F.flatten(marks))
    where = lambda e: F.get(F.filter("__m", lambda m: m.no == e.equation_no), 0).section_id
    rows = pinned(rows, equations=F.transform("equations", lambda e: e.withField("section_id", where(e))))
    number = lambda c: c.withField("chunk_id", F.concat("paper_id", F.lit("_chunk_"), F.format_string("%04d", c.chunk_no)))
    rows = pinned(rows, chunks=F.transform("chunks", number))
    filled = F.exists("sections", lambda s: s.text != "")
    words = F.aggregate("sections", F.lit(0).cast("long"), lambda n, s: n + F.when(s.text != "", T.word_count(F.concat_ws("\n", s.heading, s.text))).otherwise(F.lit(0).cast("long")))
    named = lambda tests: F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))
    rows = rows.select(
        "paper_id", "sections", "equations", "chunks", *[F.size(c).cast("long").alias(f"{c}_count") for c in ("sections", "equations", "chunks")], words.alias("plain_text_word_count"), filled.alias("filled"),
        named([(~filled, "plain_text_empty"), (F.size("chunks") == 0, "chunk_generation_empty")]).alias("errors"),
        named([(F.size("sections") == 0, "section_extraction_weak"), (F.size("equations") == 0, "equation_extraction_weak")]).alias("warnings"),
    )
    return rows.withColumn("parsing_status", parsing_status(F.size("errors"), F.size("warnings"), F.col("filled"), F.col("chunks_count"))).drop("filled")


def parsed(sources: DataFrame) -> dict[str, DataFrame]:
    """sources(paper_id, text) -> sections, equations with their section, chunks, and papers with counts and status: views of one parse that is written once."""
    return views(frozen(nested(sources)))


def views(rows: DataFrame) -> dict[str, DataFrame]:
    """nested() -> its tables."""
    out = {kind: rows.select("paper_id", F.inline(kind)) for kind in ("sections", "equations", "chunks")}
    return out | {"papers": rows.drop("sections", "equations", "chunks")}


def parse_sources(blobs: DataFrame, metadata: DataFrame | None = None) -> dict[str, DataFrame]:
    """blobs(paper_id, content), metadata(arxiv_id, title, abstract, ...) -> sections, equations, chunks, and papers, of which none is lost.

    Blobs are opened once and parsed once. A source that can't be read is a paper of status failed with its error; so is one
    without metadata, if there are any, which isn't parsed at all. files names the tables that hold a paper's parts.
    """
    names = ["paper_id", "arxiv_id", "title", "abstract", "parsing_status", "source_type", "sections_count", "equations_count", "chunks_count", "plain_text_word_count", "errors", "warnings"]
    known = blobs.select("paper_id").distinct().withColumn("arxiv_id", F.col("paper_id")).withColumn("title", F.col("paper_id")).withColumn("abstract", F.lit(""))
    if metadata is not None:
        key = T.paper_key(F.col("arxiv_id"))
        told = metadata.select(T.safe_paper_id(F.col("arxiv_id")).alias("paper_id"), key.alias("arxiv_id"), F.coalesce(F.nullif("title", F.lit("")), key).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"))
        told = told.groupBy("paper_id").agg(F.min(F.struct("arxiv_id", "title", "abstract")).alias("m")).select("paper_id", "m.*")
        known = blobs.select("paper_id").distinct().join(told, "paper_id", "left")
    known = frozen(known)
    found = frozen(readers.sniff(blobs.join(known.where("arxiv_id IS NOT NULL").select("paper_id"), "paper_id", "left_semi")))
    rows = frozen(nested(flattened(found.where("status = 'latex_source'").select("paper_id", "path", "text"))))
    tables = views(rows)
    lost = found.where("status <> 'latex_source'").select("paper_id", F.col("error").alias("kind")).union(known.where("arxiv_id IS NULL").select("paper_id", F.lit("metadata_error").alias("kind")))
    lost = lost.join(known.drop("arxiv_id"), "paper_id").withColumn("arxiv_id", F.col("paper_id"))
    good = tables["papers"].join(known, "paper_id").withColumn("source_type", F.lit("latex_source"))
    papers = good.select(*names).unionByName(failed_papers(lost).select(*names))
    kinds = ["sections", "equations", "chunks"]
    places = F.map_filter(F.create_map(*[x for k in kinds for x in (F.lit(k), F.when(F.col(f"{k}_count") > 0, F.lit(k)))]), lambda _, v: v.isNotNull())
    return tables | {"papers": papers.withColumn("files", places)}


def parsing_status(errors: Column, warnings: Column, has_text: Column, chunks: Column) -> Column:
    return F.when(errors > 0, F.when(has_text & (chunks > 0), "partial").otherwise("failed")).when(warnings > 0, "partial").otherwise("success")


def failed_papers(papers: DataFrame) -> DataFrame:
    """papers(arxiv_id, metadata fields or null, kind, message) that can't be parsed -> their records: no parts, one error, status failed."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in papers.columns else F.lit("").alias(c)
    key = T.paper_key(F.col("arxiv_id"))
    return papers.select(
        T.safe_paper_id(key).alias("paper_id"), key.alias("arxiv_id"), empty("title"), empty("abstract"), F.lit("failed").alias("parsing_status"),
        F.when(F.col("kind") == "source_unavailable", "unavailable").otherwise("error").alias("source_type"), *[F.lit(0).cast("long").alias(f"{n}_count") for n in ("sections", "equations", "chunks")],
        F.lit(0).cast("long").alias("plain_text_word_count"), F.array(F.when(F.col("kind").isin(ERRORS), F.col("kind")).otherwise("unknown_error")).alias("errors"), F.array().cast("array<string>").alias("warnings"),
    )


def parsing_errors(papers: DataFrame) -> DataFrame:
    """papers(errors array) -> (label, records) of every kind of error; unknown kinds count as unknown_error."""
    return records.zero_filled(papers.select(F.explode("errors").alias("kind")), F.coalesce("kind", F.lit("unknown_error")), ERRORS, "unknown_error")


def parsing_summary(papers: DataFrame, requested: int) -> DataFrame:
    status = F.coalesce("parsing_status", F.lit("failed"))
    out = papers.agg(*[F.count_if(status == s).alias(s) for s in ("success", "partial", "failed")])
    advice = F.when(F.col("failed") > 0, "fix failures first").when(F.col("partial") > 0, "look at partial papers").otherwise("go on to review chunks")
    return out.select(F.lit(requested).cast("long").alias("requested"), "*", advice.alias("recommendation"))


def included(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("parsing_status").isin(INCLUDED))


def chunks_v0(chunks: DataFrame, papers: DataFrame, domain: str, source: str) -> DataFrame:
    """chunks(paper_id, chunk_id, ...) of included papers, with the paper's fields and a map of where they come from."""
    own = included(papers).select("paper_id", F.col("arxiv_id").alias("__a"), F.nullif("title", F.lit("")).alias("__t"), F.col("parsing_status").alias("__s"), F.col("source_type").alias("__o"), F.col("paper_dir").alias("__d"))
    rows = chunks.join(own, "paper_id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    origin = {"domain": F.lit(domain), "source_pilot": F.lit(source), "paper_dir": text("__d"), "source_file": F.concat(text("__d"), F.lit("/chunks.jsonl")), "parsing_status": text("__s"), "source_type_original": text("__o")}
    return rows.select(
        text("chunk_id").alias("chunk_id"), "paper_id", text("__a").alias("arxiv_id"), F.coalesce("__t", text("title")).alias("title"), *[text(c).alias(c) for c in ("source_type", "section_id", "section_heading", "text")],
        F.coalesce("word_count", F.lit(0)).cast("long").alias("word_count"), F.create_map(*[x for k, v in origin.items() for x in (F.lit(k), v)]).alias("metadata"),
    )


def equations_v0(equations: DataFrame, papers: DataFrame) -> DataFrame:
    """equations(paper_id, equation_id, ...) of included papers with an id that is unique among all papers."""
    own = included(papers).select("paper_id", "arxiv_id", "title")
    return equations.join(own, "paper_id").withColumn("global_equation_id", F.concat_ws("_", "paper_id", F.coalesce("equation_id", F.lit(""))))


def chunks_v1(chunks: DataFrame, papers: DataFrame, equations: DataFrame | None = None) -> DataFrame:
    """chunks(pos, chunk_id, paper_id, arxiv_id, title, section, section_id, source_type, text) in their second form.

    Stable ids that run through each paper, resolved papers and titles, sorted flags of what the audit found and
    of what is still missing, lengths, and references to the first form, to equations and to the paper's record.
    """
    rows = audit.with_flags(chunks, papers)
    rows = audit.resolve_papers(rows, papers)
    rows = rows.withColumn("resolved_paper_id", F.when(T.blank(F.col("resolved_paper_id")), "unknown_paper").otherwise(T.trim(F.col("resolved_paper_id"))))
    known = papers.select(F.col("paper_id").alias("__p")).where("__p IS NOT NULL").distinct().withColumn("paper_record_available", F.lit(True))
    rows = audit.with_v1_ids(rows).join(known, F.col("resolved_paper_id") == F.col("__p"), "left").drop("__p")
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("equation_ids", empty) if equations is None else audit.attach_equations(rows, equations)
    first = lambda *columns: T.trim(F.coalesce(*[F.nullif(T.trim(F.col(c).cast("string")), F.lit("")) for c in columns], F.lit("")))
    kind = F.when(F.trim("source_type").isin(audit.AUDIT_TYPES), F.trim("source_type")).otherwise("unknown")
    late = F.array(F.when(first("arxiv_id") == "", "missing_arxiv_id"), F.when(first("title", "paper_title") == "", "missing_title"), F.when(kind == "unknown", "unknown_source_type"))
    return rows.select(
        "pos", F.col("chunk_id_v1").alias("chunk_id"), F.col("resolved_paper_id").alias("paper_id"), first("arxiv_id").alias("arxiv_id"), first("title", "paper_title").alias("title"), kind.alias("source_type"),
        first("section").alias("section"), "section_normalized", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("text_length_chars"), F.size(T.tokens_v1(F.col("text"))).cast("long").alias("text_length_tokens_est"),
        F.array_sort(F.array_distinct(F.concat("quality_flags", F.array_compact(late)))).alias("quality_flags"),
        F.struct(F.col("chunk_id").alias("parent_chunk_id"), "equation_ids", F.coalesce("paper_record_available", F.lit(False)).alias("paper_record_available")).alias("source_refs"),
    )


def id_map(second: DataFrame) -> DataFrame:
    """(old, new) ids of chunks; the last one of equal old ids counts."""
    rows = second.select("pos", F.col("source_refs.parent_chunk_id").alias("old"), F.col("chunk_id").alias("new"))
    return rows.groupBy("old").agg(F.max_by("new", "pos").alias("new"))


def run_error(run: Column) -> Column:
    """The first rule that a run's record (a struct of strings) breaks; null if it is valid."""
    names = ["run_id", "created_at", "backend", "model", "prompt_version", "prompt_template_sha256", "extraction_schema_version"]
    rules = [F.when(T.blank(run[n]), F.lit(f"blank: {n}")) for n in names]
    rules += [F.when(~run["created_at"].endswith("Z"), "not in UTC: created_at"), F.when(F.length(run["prompt_template_sha256"]) != 64, "no digest: prompt_template_sha256")]
    return F.coalesce(*rules)


def smoke_error(record: Column) -> Column:
    """The first way in which a record (variant) of an offline run lacks the shape of a traceable one; null if it has it."""
    parts = {"source": [f for f in records.METADATA if f != "abstract"], "extraction": records.EXTRACTION, "run": []}
    rules = []
    for part, fields in parts.items():
        keys = T.object_keys(F.try_variant_get(record, f"$.{part}", "variant"))
        rules += [F.when(keys.isNull(), F.lit(f"no object: {part}")), *[F.when(~F.array_contains(keys, f), F.lit(f"missing: {part}.{f}")) for f in fields]]
    names = ["run_id", "created_at", "backend", "model", "prompt_version", "prompt_template_sha256", "extraction_schema_version"]
    run = F.struct(*[F.try_variant_get(record, f"$.run.{n}", "string").alias(n) for n in names])
    rules += [run_error(run), *[F.when(run[n] != "fake", F.lit(f"not offline: {n}")) for n in ("backend", "model")]]
    return F.coalesce(*rules)
