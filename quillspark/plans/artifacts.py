"""Queries over files that are written and read again, formal summaries, manifests and pilots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import answers as A
from ..operators import dataset, gate, manifest, pilot, questions, records, reports
from ..operators import retrieval as R
from ..operators.shared import frozen, scratch
from ..sources import appendlog, paperfolders, readers, sinks
from . import answers as PA
from . import retrieval as P


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _md5(column: str):
    return F.md5(F.col(column).cast("binary"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as traceable records: some without a source, with an odd confidence, or with a blank model."""
    text = F.col("doc_id").cast("string")
    source = F.when(F.col("doc_id") % 6 > 0, F.struct(text.alias("arxiv_id"), F.col("source").alias("title"), F.array("source").alias("authors"), F.array("lang").alias("categories"), F.lit("2020").alias("published"), F.when(F.col("doc_id") % 7 > 0, "u").alias("url")))
    confidence = F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "certain", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    extraction = F.struct(*[F.lit("x").alias(f) for f in records.EXTRACTION[:-1]], confidence.alias("confidence"))
    run = F.struct(text.alias("run_id"), F.lit("2020Z").alias("created_at"), F.lit("fake").alias("backend"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).otherwise(" ").alias("model"), F.lit("v1").alias("prompt_version"), F.col("source").alias("prompt_template_sha256"), F.lit("s").alias("extraction_schema_version"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(source.alias("source"), extraction.alias("extraction"), run.alias("run"))).alias("text"))
    return rows.select(F.col("doc_id").alias("line"), F.parse_json("text").alias("record"))


def formal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.group_counts(_records(spark, sf_dir))


def formal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records.finding_counts(records.findings(_records(spark, sf_dir)), 3)
    return got.select("kind", "records", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("first_lines"))


def formal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.formal_summary(_records(spark, sf_dir))


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines with sorted keys, written, appended to, and read back line by line."""
    docs, path = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), scratch(spark, "jsonl")
    sinks.write_jsonl(docs.where("doc_id % 2 = 0"), path)
    sinks.write_jsonl(docs.where("doc_id % 2 = 1"), path, "append")
    get = lambda f, kind="string": F.variant_get("record", f"$.{f}", kind).alias(f)
    rows = readers.jsonl(spark, path).select("file", "line", get("doc_id", "long"), get("text"), get("lang"))
    ends = rows.groupBy("file").agg(F.max("line").alias("last"), F.count("*").alias("n"))
    return rows.join(ends, "file").select("doc_id", _md5("text").alias("text_md5"), "lang", (F.col("last") == F.col("n")).alias("numbered"))


def jsonl_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some are no objects: marked, not lost. Valid ones go to one sink, the others to the quarantine."""
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("no json "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.to_json(F.array("doc_id"))).otherwise(F.to_json(F.struct("doc_id")))
    path, good, bad = (scratch(spark, n) for n in ("lines", "good", "bad"))
    _t(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    rows = readers.jsonl(spark, path, permissive=True).select("text", "bad")
    sinks.append_valid(rows, ~F.col("bad"), good, bad)
    sinks.append_valid(rows.where("bad"), F.lit(False), good, bad)
    sides = [spark.read.schema("text string, bad boolean").json(p).select(F.lit(n).alias("sink"), "text") for n, p in (("good", good), ("bad", bad))]
    return sides[0].union(sides[1]).groupBy("sink", "text").agg(F.count("*").alias("times"))


def append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four batches to three sinks: one batch comes twice, another was cut short before its commit and is repeated."""
    docs, base = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), scratch(spark, "log")
    sink = F.when(F.length("text") > 500, "long").otherwise(F.when(F.col("text").isNotNull(), "short"))
    appendlog.stage(docs.where("doc_id % 4 = 2"), sink, base, "part-2")
    for n in (0, 1, 2, 3, 1):
        appendlog.append(docs.where(F.col("doc_id") % 4 == n), sink, base, f"part-{n}")
    parts = [appendlog.read(spark, base, s, "doc_id long, text string, lang string").withColumn("sink", F.lit(s)) for s in ("long", "short", "none")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "sink", "batch", "lang", _md5("text").alias("text_md5"))


def paper_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers in folders of their own, some failed, with their text and language as chunks, read back by the data source."""
    docs, root = _t(spark, sf_dir, "documents").withColumn("paper_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), scratch(spark, "papers")
    status = F.element_at(F.array(F.lit("success"), F.lit("partial"), F.lit("failed")), (F.col("doc_id") % 3 + 1).cast("int"))
    papers = docs.select("paper_id", F.col("source").alias("title"), status.alias("parsing_status"), F.lit(2).alias("chunks_count"))
    chunks = docs.select("paper_id", F.posexplode(F.array("text", "lang")).alias("pos", "text"))
    paperfolders.write({"papers": papers, "chunks": chunks}, root)
    own = paperfolders.read(spark, root).select("paper_id", "title", "parsing_status", "chunks_count")
    held = paperfolders.read(spark, root, "chunks").select("paper_id", "pos", F.get_json_object("record", "$.text").alias("text"))
    got = own.join(held, "paper_id", "left")
    return got.select("paper_id", "title", "parsing_status", "chunks_count", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), _md5("text").alias("text_md5"))


def metadata_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as a JSON list of metadata records, read back under the contract."""
    docs = _t(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    text = F.col("doc_id").cast("string")
    one = F.struct(F.concat(F.lit("T "), text).alias("title"), F.array("source", "lang").alias("authors"), text.alias("arxiv_id"), F.lit("We do.").alias("abstract"), F.array("lang").alias("categories"), F.lit("2020").alias("published"), F.lit("u").alias("url"), F.lit("more").alias("note"))
    lists = docs.groupBy("source", (F.col("doc_id") % 8).alias("share")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("value"))
    path = scratch(spark, "metadata")
    lists.repartition("source", "share").select("value").write.option("maxRecordsPerFile", 1).text(path)
    got = readers.metadata_records(spark, path)
    return got.select(F.col("arxiv_id").cast("long").alias("doc_id"), "title", F.array_join("authors", ",").alias("authors"), F.array_join("categories", ",").alias("categories"))


def id_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in a text file, between comments and blank lines."""
    path = scratch(spark, "ids")
    line = F.concat(F.lit("# head\n\n  arXiv:"), F.col("doc_id").cast("string"), F.lit("v1  # "), F.coalesce("source", F.lit("")), F.lit("\n"))
    _t(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    got = readers.id_list(spark, path)
    return got.select(T.paper_key(F.col("id")).alias("key"), F.lit(True).alias("clean"))


def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as a JSON document and read back as an object."""
    path = scratch(spark, "report")
    row = _t(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources")).first()
    sinks.write_report(spark, row.asDict() | {"name": "über"}, path)
    whole = spark.read.text(path, wholetext=True).count()
    get = lambda f, kind: F.variant_get("record", f"$.{f}", kind).alias(f)
    return readers.json_document(spark, path).select(get("documents", "long"), get("sources", "long"), get("name", "string"), F.lit(whole).cast("long").alias("files"))


def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors under two models' names, written to one cache; one model's are read back."""
    path = scratch(spark, "vectors")
    rows = _t(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", V.normalize(F.col("embedding")).alias("v"))
    for name in ("one", "two"):
        sinks.write_vectors(rows.withColumn("model_key", F.lit(name)), path)
    got = sinks.read_vectors(spark, path, "two")
    return got.select("vec_id", F.round(V.norm(F.col("v")), 5).alias("norm"), F.round(V.dot(F.col("v"), F.array_repeat(F.lit(1.0), 10)), 5).alias("first_ten"))


def file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object, a text and a file that isn't there, in an inventory."""
    regions = _t(spark, sf_dir, "region").select("r_name", "r_regionkey").orderBy("r_regionkey")
    paths = {n: scratch(spark, n) for n in ("object", "text")}
    regions.agg(F.count("*").alias("regions")).coalesce(1).write.json(paths["object"])
    regions.coalesce(1).select(F.concat_ws(",", "r_regionkey", "r_name").alias("value")).write.text(paths["text"])
    wanted = [(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(p).select(gate.plain_path(F.col("path"))).first()[0], n) for n, p in paths.items()]
    entries = gate.file_entries(spark, [*wanted, (f"{paths['text']}/gone.json", "gone")])
    state = gate.manifest_summary(entries).select(F.size("missing_paths").cast("long").alias("missing"), F.col("status"))
    return entries.select("role", "exists", "size_bytes", "sha256", "json_top_level_type").crossJoin(F.broadcast(state))


def roles_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a benchmark's folder, whose names say their roles."""
    forms = ["metadata_{}.json", "{}.jsonl", "{}_summary.json", "{}_manual_review_summary.json", "{}_manual_quality_checklist.md", "{}.txt", "pilot_report.json"]
    made = F.array(*[F.replace(F.lit(f), F.lit("{}"), F.col("doc_id").cast("string")) for f in forms])
    names = _t(spark, sf_dir, "documents").select(F.concat(F.lit("/out/"), F.col("doc_id").cast("string"), F.lit("/"), F.element_at(made, (F.col("doc_id") % 7 + 1).cast("int"))).alias("path"))
    return gate.role_counts(manifest.roles(names))


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's paths: as they stand, beside the manifest, below its folder, or nowhere."""
    docs, text = _t(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id").cast("string")
    known = docs.where("doc_id % 4 < 3").select(F.concat(F.element_at(F.array(F.lit("old/"), F.lit("/base/"), F.lit("/base/old/")), (F.col("doc_id") % 4 + 1).cast("int")), text).alias("path"))
    got = manifest.resolved(docs.select("doc_id", F.concat(F.lit("old/"), text).alias("path")), known, "/base")
    return got.select("doc_id", "resolved")


def pilot_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as runs of a pilot: their formal summaries and reviews added up, and what follows for each decision of the gate."""
    labels = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id")
    per = frozen(labels.groupBy("source").agg(F.count("*").alias("total_records"), *[F.count_if(F.expr(test)).alias(n) for n, test in (("reject", "toxic = 1"), ("revise", "quality = 0 AND toxic = 0"), ("pass", "quality = 1 AND toxic = 0"))]))
    reviews = per.select("total_records", "reject", "revise", "pass", F.lit(0).cast("long").alias("unclear"), F.col("pass").alias("fully_checked"), gate.review_status(F.col("total_records"), F.col("pass"), F.col("reject"), F.col("revise"), F.col("pass")).alias("status"))
    summaries = per.select(F.when(F.col("reject") == 0, "PASS").otherwise("WARN").alias("evaluation_status"), "total_records")
    entries = per.select(F.concat(F.lit("/x/"), "source").alias("path"), F.lit("jsonl_extractions").alias("role"), F.col("total_records").alias("record_count"))
    head = spark.createDataFrame([("pilot", "PASS", [])], "name string, status string, missing_paths array<string>")
    out = None
    for decision in ("ACCEPT", "REVISE", "REJECT", None):
        row = pilot.analysis(head, entries, summaries, reviews, decision).select("files", "extraction_records", "formal_summaries", "formal_pass", "formal_records", "reviews", "total_records", "fully_checked", "reject", "revise", F.coalesce("decision", F.lit("none")).alias("decision"), "recommendation", F.size("next_actions").cast("long").alias("actions"))
        out = row if out is None else out.union(row)
    return out


def question_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as a scaffold, about the first papers, some of which are not there, with their first words as keywords."""
    papers = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("arxiv_id"))
    n = F.col("item_id").cast("int")
    place = lambda k: (n + k) % 7 + 1
    scaffold = _t(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), n.cast("string")).alias("question_id"), F.col("text").alias("question"), F.element_at(F.array(*map(F.lit, questions.KINDS)), n % 6 + 1).alias("question_type"),
        F.when(n % 6 == 2, F.array(place(0), place(1))).otherwise(F.array(place(0))).alias("at"), F.array(F.lit(2), F.lit(1)).alias("fallback"), F.slice(F.split("text", " "), 1, 3).alias("expected_section_keywords"),
        F.when(n % 2 == 0, F.md5(F.col("text").cast("binary"))).alias("evaluation_criteria"), F.substring("text", 1, 20).alias("notes"),
    )
    got = questions.table(papers, scaffold)
    return got.select("question_id", "question_type", F.array_join("expected_source_arxiv_ids", ",").alias("expected"), F.array_join("expected_section_keywords", "|").alias("keywords"), "evaluation_criteria", "notes")


def failed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["metadata_error", "source_unavailable", "odd"]))
    rows = _t(spark, sf_dir, "documents").select(F.concat(F.lit("arXiv:"), F.col("doc_id").cast("string"), F.lit(".1")).alias("arxiv_id"), F.when(F.col("doc_id") % 2 > 0, F.col("source")).alias("title"), F.element_at(kinds, (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"))
    return dataset.failed_papers(rows).select("paper_id", "title", "parsing_status", "source_type", "chunks_count", F.array_join("errors", ",").alias("errors"))


def answer_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reports.answer_sheet(PA._answered(spark, sf_dir))
    return got.select(F.col("q").alias("item_id"), F.regexp_count("section", F.lit(r"(?m)^- \[C\d\] doc")).cast("long").alias("shown"), F.regexp_extract("section", r"(?m)^Cited: (.*)$", 1).alias("cited"))


def debug_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    diagnostics = PA.overlap_diagnostics(spark, sf_dir).withColumnRenamed("item_id", "q").withColumn("best_chunk", F.col("best_chunk").cast("string"))
    got = reports.debug_sections(PA._asked(spark, sf_dir), diagnostics)
    return got.select(F.col("q").alias("item_id"), F.regexp_extract("section", r"(?m)^Expected chunks: (\d+)$", 1).cast("long").alias("expected_chunks"), F.regexp_extract("section", r"(?m)^Most terms in common: (\d+),", 1).cast("long").alias("best_overlap"))


def metadata_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as metadata records that break one rule or another, or none."""
    text = F.col("doc_id").cast("string")
    case = F.col("doc_id") % 7
    record = F.struct(
        F.when(case != 1, text).alias("arxiv_id"), F.when(case == 2, F.lit(" ")).otherwise("t").alias("title"), F.when(case == 3, F.to_json(F.array(F.lit(1)))).otherwise(F.to_json(F.array("source"))).alias("authors"),
        F.lit("We do.").alias("abstract"), F.to_json(F.array("lang")).alias("categories"), F.lit("2020").alias("published"), F.lit("u").alias("url"),
    )
    body = F.regexp_replace(F.replace(F.to_json(record), F.lit("\\\""), F.lit("\"")), r'"(\[[^\]]*\])"', "$1")
    rows = _t(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.parse_json(body).alias("record"))
    return rows.select("doc_id", F.coalesce(records.metadata_error(F.col("record")), F.lit("valid")).alias("status"))


def run_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("doc_id") % 4
    names = ["run_id", "backend", "prompt_version", "extraction_schema_version"]
    run = F.struct(*[F.lit("x").alias(n) for n in names], F.when(case == 1, " ").otherwise("m").alias("model"), F.when(case == 2, "now").otherwise("2020Z").alias("created_at"), F.when(case == 3, "0").otherwise(F.sha2("source", 256)).alias("prompt_template_sha256"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.coalesce(dataset.run_error(run), F.lit("valid")).alias("status"))


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut with a mark, models' names for files, bytes read as UTF-8 or Latin-1, single values as lists."""
    docs = _t(spark, sf_dir, "documents")
    bytes_ = F.when(F.col("doc_id") % 2 == 0, F.col("source").cast("binary")).otherwise(F.encode(F.concat("source", F.lit("é")), "ISO-8859-1"))
    name = F.concat("lang", F.lit(":"), "source", F.lit("/1.5"))
    return docs.select("doc_id", F.md5(T.truncate(F.col("text"), 200).cast("binary")).alias("cut_md5"), T.model_slug(F.when(F.col("doc_id") % 3 == 0, "fake").otherwise("other"), name).alias("slug"), T.decode(bytes_).alias("read"), F.size(T.as_list(F.when(F.col("doc_id") % 5 > 0, F.col("lang")))).cast("long").alias("listed"))


def dataset_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = _t(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    papers = docs.select(text.alias("paper_id"), F.concat(F.lit("a"), text).alias("arxiv_id"), F.col("source").alias("title"), F.when(F.col("doc_id") % 3 > 0, "success").otherwise("failed").alias("parsing_status"))
    found = docs.select(text.alias("paper_id"), F.when(F.col("doc_id") % 2 > 0, "eq_001").alias("equation_id"))
    return dataset.equations_v0(found, papers).select(F.col("paper_id").cast("long").alias("doc_id"), "global_equation_id", "title")


def abstracts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).cast("string").alias("arxiv_id"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(" ").alias("abstract"))
    known = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), (F.col("item_id") % 30).cast("string").alias("arxiv_id"), F.when(F.col("item_id") % 4 > 0, F.concat(F.lit("item "), F.col("item_id").cast("string"))).otherwise("").alias("abstract"))
    return records.with_abstract(docs, known).select("doc_id", "abstract")


def prefixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, said = _t(spark, sf_dir, "benchmark"), F.concat(F.lit("item "), F.col("item_id").cast("string"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), A.with_prefix(said, name, "query").alias("query"), A.with_prefix(said, name, "passage").alias("passage")) for name in A.MODELS]))
    return rows.select("item_id", each.alias("e")).select("item_id", "e.*")


def sniffed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as downloaded sources: plain markup, PDF, a page that says nothing is there, anything else."""
    forms = F.array(F.concat(F.lit("\\documentclass{a} "), F.coalesce("source", F.lit(""))), F.lit("%PDF-1.4 x"), F.lit("<HTML>none</HTML>"), F.concat(F.lit("odd "), F.col("doc_id").cast("string")))
    blobs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.element_at(forms, (F.col("doc_id") % 4 + 1).cast("int")).cast("binary").alias("content"))
    return readers.sniff(blobs).select(F.col("paper_id").cast("long").alias("doc_id"), "status", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("error", F.lit("")).alias("error"))


def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feeds of two entries each, one of them without an abstract."""
    text = F.col("doc_id").cast("string")
    entry = lambda n, said: F.concat(F.lit("<entry><id>http://x.org/abs/"), text, F.lit(f".{n}v1</id><title> Paper\n "), text, F.lit(f"</title><summary>{said}</summary><author><name>A B</name></author><category term='"), "lang", F.lit("'/><published>2020</published></entry>"))
    feeds = _t(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), entry(1, "We  do."), entry(2, ""), F.lit("</feed>")).alias("xml"))
    return readers.atom(feeds).select("arxiv_id", "title", "abstract", F.array_join("authors", ",").alias("authors"), F.array_join("categories", ",").alias("categories"), "url")


def hashed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions against documents by hashed vectors of 64 places: the three best, those of score zero and below included."""
    slot = lambda t: V.md5_slot(t, 64)
    docs = frozen(R.dense(R.hashed_vectors(P._docs(spark, sf_dir), T.tokens_v1(F.col("text")), 64, slot=slot), 64))
    asked = R.dense(R.hashed_vectors(P._questions(spark, sf_dir).withColumnRenamed("q", "doc"), T.tokens_v1(F.col("question")), 64, slot=slot), 64)
    got = R.vector_top_k(asked.select((-F.col("doc") - 1).alias("q"), "v"), docs, 3)
    return got.select((-F.col("q") - 1).alias("item_id"), "rank", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        formal_groups, formal_findings, formal_status, jsonl_round_trip, jsonl_quarantine, append_batches, paper_folders, metadata_round_trip, id_list_round_trip, report_round_trip, vector_cache, file_entries,
        roles_by_name, resolved_paths, pilot_analysis, question_table, failed_papers, answer_sheets, debug_sections, hashed_top_k,
        metadata_contract, run_contract, text_helpers, dataset_equations, abstracts_filled, prefixed_texts, sniffed_sources, atom_entries,
    )
}

# SQL that several queries share.
_CONFIDENCE = "['low', 'medium', 'high', 'certain', ''][doc_id % 5 + 1]"
_GROUPS = {"confidence": _CONFIDENCE, "backend": "'fake'", "model": "CASE WHEN doc_id % 4 > 0 THEN lang END", "prompt_version": "'v1'", "prompt_template_sha256": "source", "extraction_schema_version": "'s'"}
_LACKING = {
    **{f"source.{f}": "doc_id % 6 = 0" for f in ("arxiv_id", "authors", "categories", "published")}, "source.title": "doc_id % 6 = 0 OR source IS NULL", "source.url": "doc_id % 6 = 0 OR doc_id % 7 = 0",
    "extraction.confidence": "doc_id % 5 = 4", "run.model": "doc_id % 4 = 0 OR lang IS NULL", "run.prompt_template_sha256": "source IS NULL", "invalid confidence": "doc_id % 5 = 3",
}
_FOUND = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, doc_id AS line FROM documents WHERE {test}" for kind, test in _LACKING.items()) + ")"
_SLOTS = """SELECT id, i, CASE WHEN n = 0 THEN w ELSE w / n END AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS n FROM (
  SELECT id, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(tf))) AS w FROM (
    SELECT id, ('0x' || substr(md5(term), 1, 15))::BIGINT AS h, count(*) AS tf FROM (SELECT {id} AS id, unnest({tokens}) AS term FROM {table}) GROUP BY id, term) GROUP BY ALL))"""

ORACLES = {
    "formal_groups": " UNION ALL ".join(f"SELECT '{name}' AS field, coalesce(nullif({value}, ''), '<missing>') AS value, count(*) AS records FROM documents GROUP BY ALL" for name, value in _GROUPS.items()),
    "formal_findings": f"""WITH f AS ({_FOUND}), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY line) AS n FROM f)
SELECT kind, count(*) AS records, string_agg(CASE WHEN n <= 3 THEN line::VARCHAR END, ',' ORDER BY line) AS first_lines FROM r GROUP BY kind""",
    "formal_status": f"""WITH f AS ({_FOUND}) SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents WHERE doc_id % 6 > 0) AS records_with_source,
(SELECT count(DISTINCT line) FROM f) AS records_with_findings, 'WARN' AS status""",
    "jsonl_round_trip": "SELECT doc_id, md5(text) AS text_md5, lang, true AS numbered FROM documents",
    "jsonl_quarantine": """SELECT CASE WHEN doc_id % 3 = 2 THEN 'good' ELSE 'bad' END AS sink, CASE doc_id % 3 WHEN 0 THEN 'no json ' || doc_id WHEN 1 THEN '[' || doc_id || ']' ELSE '{"doc_id":' || doc_id || '}' END AS text,
CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 2 END AS times FROM documents""",
    "metadata_round_trip": "SELECT doc_id, 'T ' || doc_id AS title, source || ',' || lang AS authors, lang AS categories FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL",
    "id_list_round_trip": "SELECT doc_id || 'v1' AS key, true AS clean FROM documents",
    "report_round_trip": "SELECT count(*) AS documents, count(DISTINCT source) AS sources, 'über' AS name, 1 AS files FROM documents",
    "vector_cache": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END AS norm, round(CASE WHEN n = 0 THEN 0 ELSE list_sum(e[1:10]) / n END, 5) AS first_ten FROM v""",
    "append_batches": """SELECT doc_id, CASE WHEN length(text) > 500 THEN 'long' WHEN text IS NOT NULL THEN 'short' ELSE 'none' END AS sink, 'part-' || (doc_id % 4) AS batch, lang, md5(text) AS text_md5
FROM documents WHERE doc_id IS NOT NULL""",
    "paper_folders": """WITH p AS (SELECT 'd' || doc_id AS paper_id, coalesce(source, '') AS title, CASE doc_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' ELSE 'failed' END AS parsing_status, text, lang FROM documents),
c AS (SELECT paper_id, 1 AS pos, text FROM p WHERE parsing_status <> 'failed' UNION ALL SELECT paper_id, 2, lang FROM p WHERE parsing_status <> 'failed')
SELECT p.paper_id, title, parsing_status, 2::BIGINT AS chunks_count, coalesce(c.pos, 0)::BIGINT AS pos, md5(c.text) AS text_md5 FROM p LEFT JOIN c ON c.paper_id = p.paper_id""",
    "file_entries": """WITH f AS (SELECT 'object' AS role, '{"regions":' || count(*) || '}' || chr(10) AS content, 'object' AS kind FROM region
UNION ALL SELECT 'text', string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey), NULL FROM region UNION ALL SELECT 'gone', NULL, NULL)
SELECT role, content IS NOT NULL AS "exists", strlen(content)::BIGINT AS size_bytes, sha256(content) AS sha256, kind AS json_top_level_type, 1 AS missing, 'WARN' AS status FROM f""",
    "roles_by_name": """SELECT CASE doc_id % 7 WHEN 0 THEN 'metadata' WHEN 1 THEN 'jsonl_extractions' WHEN 2 THEN 'summary' WHEN 3 THEN 'manual_review_summary' WHEN 4 THEN 'manual_quality_checklist' ELSE 'pilot_report' END AS role, count(*) AS files
FROM documents WHERE doc_id % 7 <> 5 GROUP BY ALL""",
    "resolved_paths": "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '/base/' || doc_id WHEN 2 THEN '/base/old/' || doc_id ELSE 'old/' || doc_id END AS resolved FROM documents",
    "pilot_analysis": """WITH l AS (SELECT source, count(*) AS n, count_if(toxic = 1) AS reject, count_if(quality = 0 AND toxic = 0) AS revise, count_if(quality = 1 AND toxic = 0) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY source),
t AS (SELECT count(*) AS files, sum(n)::BIGINT AS extraction_records, count(*) AS formal_summaries, count_if(reject = 0)::BIGINT AS formal_pass, sum(n)::BIGINT AS formal_records, count(*) AS reviews, sum(n)::BIGINT AS total_records,
  sum(passed)::BIGINT AS fully_checked, sum(reject)::BIGINT AS reject, sum(revise)::BIGINT AS revise FROM l),
d AS (SELECT * FROM (VALUES ('ACCEPT', 'READY_FOR_NEXT_PILOT_CYCLE', 3), ('REVISE', 'REVISE_BEFORE_SCALING', 3), ('REJECT', 'STOP_AND_FIX', 3), ('none', 'RUN_QUALITY_GATE', 2)) v(decision, recommendation, actions))
SELECT t.*, d.* FROM t, d""",
    "question_table": f"""WITH f AS (SELECT list(a ORDER BY p) AS ids FROM (SELECT doc_id AS p, 'a' || doc_id AS a FROM documents ORDER BY doc_id LIMIT 5)),
b AS (SELECT *, item_id % 7 + 1 AS one, (item_id + 1) % 7 + 1 AS two, {questions.KINDS}[item_id % 6 + 1] AS kind FROM benchmark)
SELECT 'q' || item_id AS question_id, kind AS question_type, CASE WHEN kind = 'comparison' THEN CASE WHEN greatest(one, two) <= len(ids) THEN ids[one] || ',' || ids[two] ELSE ids[2] || ',' || ids[1] END
  WHEN one <= len(ids) THEN ids[one] ELSE ids[2] || ',' || ids[1] END AS expected, array_to_string(string_split(text, ' ')[1:3], '|') AS keywords, CASE WHEN item_id % 2 = 0 THEN md5(text) ELSE '' END AS evaluation_criteria, substr(text, 1, 20) AS notes
FROM b, f""",
    "failed_papers": """SELECT doc_id || '_1' AS paper_id, CASE WHEN doc_id % 2 > 0 THEN coalesce(source, '') ELSE '' END AS title, 'failed' AS parsing_status, CASE WHEN doc_id % 3 = 1 THEN 'unavailable' ELSE 'error' END AS source_type,
0 AS chunks_count, CASE doc_id % 3 WHEN 0 THEN 'metadata_error' WHEN 1 THEN 'source_unavailable' ELSE 'unknown_error' END AS errors FROM documents""",
    "answer_sheets": PA._ASKED + " SELECT item_id, 5 AS shown, CASE WHEN refused THEN 'nothing' ELSE 'doc' || first END AS cited FROM asked",
    "debug_sections": PA._ASKED + f""", o AS ({PA.ORACLES['overlap_diagnostics']}) SELECT item_id, expected_chunks, best_overlap FROM asked JOIN o USING (item_id) WHERE has_expected AND hit_rank IS NULL""",
    "hashed_top_k": f"""WITH d AS ({_SLOTS.format(id='doc_id', tokens=P.TOK1.format('text'), table='documents')}), q AS ({_SLOTS.format(id='item_id', tokens=P.TOK1.format('text'), table='benchmark')}),
s AS (SELECT q.id AS q, d.id AS doc, sum(q.w * d.w) AS score FROM q JOIN d USING (i) GROUP BY ALL),
a AS (SELECT q.id AS q, d.id AS doc FROM (SELECT DISTINCT id FROM q) q CROSS JOIN (SELECT DISTINCT id FROM d) d),
r AS (SELECT a.q, a.doc, coalesce(s.score, 0) AS score, row_number() OVER (PARTITION BY a.q ORDER BY round(coalesce(s.score, 0), 9) DESC, a.doc) AS rank FROM a LEFT JOIN s ON s.q = a.q AND s.doc = a.doc QUALIFY rank <= 3)
SELECT q AS item_id, rank, doc AS doc_id, round(score, 6) AS score FROM r""",
    "metadata_contract": """SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'missing: arxiv_id' WHEN 2 THEN 'blank: title' WHEN 3 THEN 'not a list of strings: authors' ELSE 'valid' END AS status FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""",
    "run_contract": "SELECT doc_id, ['valid', 'blank: model', 'not in UTC: created_at', 'no digest: prompt_template_sha256'][doc_id % 4 + 1] AS status FROM documents",
    "text_helpers": r"""SELECT doc_id, md5(CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substr(text, 1, 176), '\s+$', '') || chr(10) || chr(10) || '[abstract truncated]' END) AS cut_md5,
CASE WHEN doc_id % 3 = 0 THEN 'fake' ELSE lang || '_' || source || '_1_5' END AS slug, CASE WHEN doc_id % 2 = 0 THEN source ELSE source || 'é' END AS read, CASE WHEN doc_id % 5 > 0 AND lang IS NOT NULL THEN 1 ELSE 0 END AS listed FROM documents""",
    "dataset_equations": "SELECT doc_id, CASE WHEN doc_id % 2 > 0 THEN doc_id || '_eq_001' ELSE doc_id || '_' END AS global_equation_id, source AS title FROM documents WHERE doc_id % 3 > 0",
    "abstracts_filled": """WITH k AS (SELECT (item_id % 30)::VARCHAR AS id, arg_max('item ' || item_id, item_id) AS abstract FROM benchmark WHERE item_id % 4 > 0 GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND trim(coalesce(source, '')) <> '' THEN source ELSE coalesce(k.abstract, '') END AS abstract FROM documents LEFT JOIN k ON k.id = (doc_id % 40)::VARCHAR""",
    "prefixed_texts": """SELECT item_id, m AS model, CASE WHEN m = 'e5-small-v2' THEN 'query: ' ELSE '' END || 'item ' || item_id AS query, CASE WHEN m = 'e5-small-v2' THEN 'passage: ' ELSE '' END || 'item ' || item_id AS passage
FROM benchmark, (SELECT unnest(['all-MiniLM-L6-v2', 'e5-small-v2', 'bge-m3']) AS m)""",
    "sniffed_sources": """SELECT doc_id, ['latex_source', 'unavailable', 'unavailable', 'error'][doc_id % 4 + 1] AS status, CASE WHEN doc_id % 4 = 0 THEN 'main.tex' ELSE '' END AS path,
['', 'pdf_fallback_skipped', 'source_unavailable', 'archive_extract_error'][doc_id % 4 + 1] AS error FROM documents""",
    "atom_entries": "SELECT doc_id || '.1v1' AS arxiv_id, 'Paper ' || doc_id AS title, 'We do.' AS abstract, 'A B' AS authors, lang AS categories, 'https://arxiv.org/abs/' || doc_id || '.1v1' AS url FROM documents WHERE lang IS NOT NULL",
}
