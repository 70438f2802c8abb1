"""Sub-commands over the library: `python -m quillspark COMMAND`. Tables are read and written by Spark, so paths may be remote."""

from __future__ import annotations

import argparse
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import answers, audit, dataset, evaluate, gate, records, reports, retrieval
from .operators import manifest as manifests
from .operators import pilot as pilots
from .operators import questions as question_tables
from .operators.shared import frozen
from .sources import appendlog, paperfolders, readers, sinks

CHUNK = "pos long, chunk_id string, paper_id string, arxiv_id string, title string, section string, section_id string, section_heading string, source_type string, text string, word_count long"
QUESTION = "question_id string, question string, question_type string, expected_source_arxiv_ids array<string>, expected_section_keywords array<string>"


def _show(df: DataFrame) -> dict:
    """A summary of one row, printed."""
    row = df.first().asDict()
    print("\n".join(f"{k}: {v}" for k, v in row.items()))
    return row


def papers(spark: SparkSession, a: argparse.Namespace) -> int:
    """Feeds of metadata, which lie in files, as JSON lines."""
    feeds = spark.read.text(a.input, wholetext=True).withColumnRenamed("value", "xml")
    sinks.write_jsonl(readers.atom(feeds), a.out)
    return 0


def address(spark: SparkSession, a: argparse.Namespace) -> int:
    print(readers.query_address(a.query, a.id, a.most))
    return 0


def extraction(metadata: DataFrame, backend: str, factory=None) -> DataFrame:
    """metadata -> source, extraction, run and error: the first rule that the model's answer breaks."""
    prompt = records.extraction_prompt(F.col("title"), F.col("abstract"))
    said = metadata.withColumn("__said", F.struct(records.fake_extraction(F.col("title")).alias("text"), F.lit(None).cast("string").alias("error")) if factory is None else records.generator(factory)(prompt))
    text = F.col("__said.text")
    fields = {"run_id": uuid.uuid4().hex, "backend": backend, "model": backend, "prompt_version": "v1", "prompt_template_sha256": records.prompt_sha256(), "extraction_schema_version": "v1"}
    run = F.struct(T.utc_now().alias("created_at"), *[F.lit(v).alias(k) for k, v in fields.items()])
    parsed = records.parse_model_json(text)
    error = F.coalesce("__said.error", F.when(parsed.isNull(), "no JSON object"), records.extraction_error(parsed, T.object_keys(parsed)))
    body = F.struct(*[F.try_variant_get(parsed, f"$.{f}", "string").alias(f) for f in records.EXTRACTION])
    source = F.struct(*[F.col(f) for f in records.METADATA])
    return said.select(source.alias("source"), body.alias("extraction"), run.alias("run"), error.alias("error"))


def extract(spark: SparkSession, a: argparse.Namespace) -> int:
    """Metadata to traceable extractions; those that break a rule go to the quarantine beside the output."""
    rows = readers.metadata_records(spark, a.input) if a.contract else readers.metadata(spark, a.input)
    rows = rows.limit(a.limit) if a.limit else rows
    out = extraction(rows, "fake")
    if a.batch:
        done = appendlog.append(out, F.when(F.col("error").isNull(), "good").otherwise("rejected"), a.out, a.batch)
        print(json.dumps(done, sort_keys=True))
    else:
        sinks.append_valid(out, F.col("error").isNull(), a.out, f"{a.out}.rejected")
    return 0


def preview(spark: SparkSession, a: argparse.Namespace) -> int:
    """The first records, printed, or all of them as a report."""
    lines = reports.record_lines(readers.jsonl(spark, a.input))
    if a.out:
        reports.write(lines, "preview", ["line"], a.out)
    else:
        print("\n".join(r.preview for r in lines.orderBy("line").limit(a.limit).collect()))
    return 0


def summary(spark: SparkSession, a: argparse.Namespace) -> int:
    """A formal summary, printed; with --out also written as a document."""
    rows = readers.jsonl(spark, a.input)
    print(records.summary_text(rows, a.input, not a.without_source))
    row = _show(records.formal_summary(rows, not a.without_source))
    if a.out:
        sinks.write_report(spark, formal_document(rows, row), a.out)
    return int(a.strict and row["status"] != "PASS")


def formal_document(rows: DataFrame, row: dict) -> dict:
    counts = records.group_counts(rows).collect()
    groups = {f"{name}_counts": {r["value"]: r["records"] for r in counts if r["field"] == name} for name in records.GROUPS}
    return {"total_records": row["total"], "records_with_source": row["records_with_source"], "evaluation_status": row["status"], **groups, "missing_fields": {r["kind"]: r["records"] for r in records.finding_counts(records.findings(rows)).collect()}}


def checklist(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = readers.jsonl(spark, a.input).orderBy("line").limit(a.limit)
    reports.write(rows.select("line", reports.review_section(F.col("line"), F.col("record")).alias("sheet")), "sheet", ["line"], a.out)
    return 0


def reviewed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The summary of review sheets; files that hold none are an error."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    records_ = gate.review_records(files)
    if records_.isEmpty():
        raise ValueError("no record of a review in " + ", ".join(paths))
    return gate.review_summary(records_, gate.CHECKS)


def review(spark: SparkSession, a: argparse.Namespace) -> int:
    row = _show(reviewed(spark, [a.input]))
    return int(a.strict and row["status"] != "PASS")


def _pairs(files: list[str]) -> list[tuple[str, str]]:
    return [(path, role) for role, _, path in (f.partition("=") for f in files)]


def manifest(spark: SparkSession, a: argparse.Namespace) -> int:
    """ROLE=PATH files: an inventory as JSON lines, and whether anything is missing."""
    entries = gate.file_entries(spark, _pairs(a.files))
    sinks.write_jsonl(entries, a.out)
    return int(_show(gate.manifest_summary(entries))["status"] != "PASS" and a.strict)


def decide(spark: SparkSession, a: argparse.Namespace) -> int:
    """The gate over an inventory of files and reviews; then what to do next."""
    entries = spark.read.schema("path string, role string, pos long, exists boolean, record_count long").json(a.input)
    state = gate.manifest_summary(entries)
    first = state.select("*", gate.manifest_verdict(F.col("status"), F.col("missing"), F.col("files")).alias("verdict")).first()
    judged = [reviewed(spark, [p]).select(gate.summary_verdict(F.col("status"), F.col("total_records"), F.col("reject"), F.col("fully_checked")).alias("verdict")) for p in a.reviews]
    verdicts = spark.createDataFrame([], "verdict string")
    for one in judged:
        verdicts = verdicts.union(one)
    out = gate.gate(first.verdict, verdicts, not a.allow_unreviewed)
    row = _show(out.withColumn("next", gate.recommendation(F.lit(first.status), F.lit(first.missing), F.col("decision"))))
    return int(a.strict and row["decision"] != "ACCEPT")


def pilot(spark: SparkSession, a: argparse.Namespace) -> int:
    """Extraction, summary, review sheets, inventory and gate, one after another, over 10 to 20 papers."""
    count = readers.metadata_records(spark, a.input).count()
    if count > 20 or (count < 10 and not a.small):
        raise ValueError("a pilot takes 10 to 20 papers")
    found, sheets, files = f"{a.out}/extractions", f"{a.out}/sheets", f"{a.out}/manifest"
    main(["extract", "--input", a.input, "--out", found])
    main(["summary", "--input", found])
    main(["checklist", "--input", found, "--out", sheets, "--limit", str(count)])
    main(["manifest", "--out", files, f"metadata={a.input}"])
    return main(["gate", "--input", files, "--reviews", sheets, *(["--strict"] if a.strict else [])])


def benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    """Two sets of metadata through the same extraction; their formal summaries and a report; with --workflow also sheets, inventory and gate."""
    groups, files = {}, []
    for name, source in (("query_a", a.first), ("query_b", a.second)):
        out = f"{a.out}/{name}"
        main(["extract", "--input", source, "--out", out])
        rows = readers.jsonl(spark, out)
        row = records.formal_summary(rows).first().asDict()
        sinks.write_report(spark, formal_document(rows, row), f"{a.out}/{name}_summary")
        groups[name] = {"input_records": readers.metadata_records(spark, source).count(), "output_records": row["total"], "evaluation_status": row["status"]}
        files += [(source, "metadata")]
        if a.workflow:
            main(["checklist", "--input", out, "--out", f"{a.out}/{name}_sheets", "--limit", str(row["total"])])
    fine = all(g["evaluation_status"] == "PASS" and g["input_records"] == g["output_records"] for g in groups.values())
    report = {"formal_status": "PASS" if fine else "WARN", "backend": "fake", "model": "fake", "prompt_template_sha256": records.prompt_sha256(), "groups": groups}
    sinks.write_report(spark, report, f"{a.out}/report")
    print(f"formal_status: {report['formal_status']}")
    if a.workflow:
        main(["manifest", "--out", f"{a.out}/manifest", *[f"{role}={path}" for path, role in files]])
        return main(["gate", "--input", f"{a.out}/manifest", "--reviews", *[f"{a.out}/{n}_sheets" for n in groups], *(["--strict"] if a.strict else [])])
    return int(a.strict and not fine)


def analyse(spark: SparkSession, a: argparse.Namespace) -> int:
    """A manifest document, formal summaries, review summaries and the gate's decision: what a pilot has come to."""
    held = manifests.read(spark, a.manifest)
    none = lambda schema: spark.createDataFrame([], schema)
    formal = "evaluation_status string, total_records long"
    reviewed_ = "status string, total_records long, fully_checked long, pass long, reject long, revise long, unclear long"
    read = lambda paths, schema: spark.read.schema(schema).option("multiLine", True).json(paths) if paths else none(schema)
    row = frozen(pilots.analysis(held, manifests.entries_of(held), read(a.summaries, formal), read(a.reviews, reviewed_), a.decision)).first().asDict()
    print("\n".join(f"{k}: {v}" for k, v in row.items()))
    sinks.write_report(spark, row | {"role_counts": {r["role"]: r["files"] for r in gate.role_counts(manifests.entries_of(held)).collect()}}, a.out)
    return int(a.strict and row["recommendation"] != "READY_FOR_NEXT_PILOT_CYCLE")


def build(spark: SparkSession, a: argparse.Namespace) -> int:
    """What `parse` has made, with the papers' metadata, as a dataset: chunks, papers, equations, questions, report and manifest."""
    if T.is_blank(a.domain):
        raise ValueError("a dataset needs a domain")
    parsed = {n: spark.read.parquet(f"{a.input}/{n}") for n in ("papers", "chunks", "equations")}
    known = readers.metadata_records(spark, a.metadata).select(T.safe_paper_id(F.col("arxiv_id")).alias("paper_id"), "arxiv_id", "title", "abstract").dropDuplicates(["paper_id"])
    own = parsed["papers"].drop("arxiv_id", "title", "abstract").join(known, "paper_id", "left").withColumns({"source_type": F.lit("latex_source"), "paper_dir": F.concat(F.lit(f"{a.input}/papers/"), "paper_id")})
    papers_ = frozen(dataset.included(own))
    chunks = parsed["chunks"].withColumnsRenamed({"heading": "section_heading"}).withColumns({"source_type": F.lit("section"), "title": F.lit(None).cast("string")})
    chunks = frozen(dataset.chunks_v0(chunks, papers_, a.domain, a.input))
    tables = {"chunks": chunks, "papers": papers_, "equations": dataset.equations_v0(parsed["equations"], papers_), "eval_questions": question_tables.table(papers_, spark.read.schema(question_tables.SCAFFOLD).json(a.scaffold) if a.scaffold else None)}
    for name, rows in tables.items():
        sinks.write_jsonl(rows, f"{a.out}/{name}")
    validation = frozen(audit.validate_chunks(chunks, papers_))
    reports.write(reports.quality_report(validation, audit.quality_counts(chunks, papers_), "Chunks"), "report", [], f"{a.out}/report")
    row = _show(validation)
    counts = {name: readers.numbered_lines(spark, f"{a.out}/{name}").count() for name in tables}
    sinks.write_report(spark, {"source": a.input, "domain": a.domain, "counts": counts, "files": {n: f"{a.out}/{n}" for n in tables}, "validation": row}, f"{a.out}/manifest")
    return int(a.strict and row["status"] != "PASS")


def smoke(spark: SparkSession, a: argparse.Namespace) -> int:
    """A pilot over made-up papers, to see that everything runs offline; each record written must have the shape of a traceable one."""
    paper = lambda n: {"arxiv_id": str(n), "title": f"Paper {n}", "authors": ["A"], "abstract": "We do.", "categories": ["x"], "published": "2020", "url": "u"}
    spark.createDataFrame([json.dumps([paper(n) for n in range(10)])], "string").coalesce(1).write.mode("overwrite").text(f"{a.out}/metadata")
    main(["pilot", "--input", f"{a.out}/metadata", "--out", f"{a.out}/pilot"])
    rows = readers.jsonl(spark, f"{a.out}/pilot/extractions").select("line", dataset.smoke_error(F.col("record")).alias("error"))
    bad = rows.agg(F.count("*").alias("n"), F.min("error").alias("error")).first()
    if not bad["n"] or bad["error"]:
        raise ValueError(f"smoke: {bad['error'] or 'no record was written'}")
    print("smoke: done")
    return 0


def parse(spark: SparkSession, a: argparse.Namespace) -> int:
    """Downloaded sources, a file each, to sections, equations, chunks and papers, those that can't be read included."""
    blobs = spark.read.format("binaryFile").load(a.input).select(T.safe_paper_id(F.regexp_extract("path", r"([^/]+?)(?:\.[a-z.]+)?$", 1)).alias("paper_id"), "content")
    known = readers.metadata_records(spark, a.metadata) if a.metadata else None
    seen = Observation("papers")
    for name, rows in dataset.parse_sources(blobs, known).items():
        if name == "papers":
            rows = rows.observe(seen, F.count("*").alias("requested"), *[F.count_if(F.col("parsing_status") == s).alias(s) for s in ("success", "partial", "failed")])
        rows.write.mode("overwrite").parquet(f"{a.out}/{name}")
    if a.folders:
        paperfolders.write({name: spark.read.parquet(f"{a.out}/{name}") for name in ("papers", *paperfolders.FILES)}, a.folders)
    _show(dataset.parsing_summary(spark.read.parquet(f"{a.out}/papers"), seen.get["requested"]))
    return 0


def second(spark: SparkSession, a: argparse.Namespace) -> int:
    """Chunks and papers (JSON lines with pos), and equations if there are any, to the second form, with audit, map of ids, a smoke search and a manifest."""
    readers.require(spark, f"{a.input}/chunks", f"{a.input}/papers")
    chunks = spark.read.schema(CHUNK).json(f"{a.input}/chunks").withColumn("section", F.coalesce("section", "section_heading"))
    papers_ = spark.read.schema("pos long, paper_id string, arxiv_id string, title string").json(f"{a.input}/papers")
    equations = None
    if a.equations:
        equations = spark.read.schema("pos long, paper_id string, section_id string, equation_id string").json(a.equations)
    dataset.chunks_v1(chunks, papers_, equations).write.mode("overwrite").parquet(f"{a.out}/chunks")
    made = spark.read.parquet(f"{a.out}/chunks")
    dataset.id_map(made).write.mode("overwrite").parquet(f"{a.out}/chunk_ids")
    sinks.write_jsonl(audit.corpus_audit(audit.with_flags(chunks, papers_)), f"{a.out}/audit")
    linked = made.agg(F.count("*").alias("chunks"), F.count_if(F.size("source_refs.equation_ids") > 0).alias("with_equations"), F.count_if(F.size("quality_flags") > 0).alias("flagged"), F.countDistinct("paper_id").alias("papers")).first().asDict()
    smoke_search = None
    if a.question:
        asked = spark.createDataFrame([("smoke", a.question)], "q string, question string")
        index = retrieval.build_index(made.withColumn("doc", F.col("chunk_id")), T.tokens_v1(F.col("text")))
        best = retrieval.retrieve(index, asked, T.tokens_v1(F.col("question")), 1).first()
        smoke_search = {"question": a.question, "chunk_id": best.doc if best else None, "score": best.score if best else 0.0}
    sinks.write_report(spark, {"source": a.input, "counts": linked, "smoke": smoke_search, "files": {n: f"{a.out}/{n}" for n in ("chunks", "chunk_ids", "audit")}}, f"{a.out}/manifest")
    print("\n".join(f"{k}: {v}" for k, v in linked.items()))
    return 0


def _dataset(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, questions, what is expected)"""
    readers.require(spark, a.chunks, a.questions)
    chunks = spark.read.schema(CHUNK).json(a.chunks).withColumn("doc", F.col("chunk_id"))
    questions = spark.read.schema(QUESTION).json(a.questions).withColumnRenamed("question_id", "q")
    return chunks, questions, questions.select("q", F.lit("arxiv_id").alias("field"), F.explode("expected_source_arxiv_ids").alias("value"))


def ranked_v1(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    fields: list[tuple[Column, int]] = [(T.tokens_v1(F.col("text")), 1), (T.tokens_v1(F.col("title")), 2), (T.tokens_v1(F.col("section_heading")), 2)]
    terms = T.query_terms(F.col("question"), F.col("question_type"), F.col("expected_section_keywords"))
    return retrieval.retrieve(retrieval.build_index(chunks, fields), questions, terms, k, distinct=True)


def retrieve(spark: SparkSession, a: argparse.Namespace) -> int:
    """Rates of hits at each k, the questions missed, and the contexts at the largest k."""
    chunks, questions, expected = _dataset(spark, a)
    asked = frozen(answers.contexts(questions, answers.hits(ranked_v1(chunks, questions, max(a.top_k)), chunks), expected))
    sinks.write_jsonl(asked, f"{a.out}/contexts")
    each = evaluate.at_each_k(asked.drop("hit"), a.top_k)
    rates = each.groupBy("k").agg(*evaluate.hit_metrics())
    sinks.write_jsonl(rates, f"{a.out}/rates")
    sinks.write_jsonl(answers.misses(each), f"{a.out}/misses")
    _show(answers.best_k(rates, a.baseline))
    return 0


def ask(spark: SparkSession, a: argparse.Namespace) -> int:
    """Retrieval by the first ranking, and answers that cite their context, unless retrieval alone is wanted."""
    chunks, questions, expected = _dataset(spark, a)
    index = retrieval.build_index(chunks, T.tokens_v0(F.col("text")))
    hits = answers.hits(retrieval.retrieve(index, questions, T.tokens_v0(F.col("question")), max(a.top_k)), chunks)
    out = frozen(answers.answers(answers.contexts(questions, hits, expected), None if a.retrieval_only else answers.CitingModel))
    sinks.write_jsonl(out, f"{a.out}/answers")
    sinks.write_jsonl(answers.error_counts(out), f"{a.out}/errors")
    _show(answers.answer_summary(out))
    return 0


def embed(spark: SparkSession, a: argparse.Namespace) -> int:
    """Hashed vectors in place of each model's, compared by hits and reciprocal ranks."""
    chunks, questions, expected = _dataset(spark, a)
    rows, top = None, max(a.top_k)
    for pos, name in enumerate(a.models or answers.MODELS):
        full, width, _, _ = answers.model_config(name)
        slot = V.blake_slot(width, full)
        text = answers.embedding_text(F.col("title"), F.col("section_heading"), F.col("text"))
        vectors = lambda table, said, kind: frozen(retrieval.dense(retrieval.hashed_vectors(table, T.tokens_v1(answers.with_prefix(said, name, kind)), width, blake=slot), width))  # noqa: B023, E731
        began = time.monotonic()
        passages = vectors(chunks, text, "passage")
        built, began = time.monotonic() - began, time.monotonic()
        asked = vectors(questions.withColumnRenamed("q", "doc"), F.col("question"), "query").withColumnRenamed("doc", "q")
        ranked = frozen(retrieval.vector_top_k(asked, passages, top))
        took = (time.monotonic() - began) / max(1, questions.count())
        got = answers.contexts(questions, answers.hits(ranked, chunks), expected).agg(*evaluate.hit_metrics())
        got = got.select(F.lit(full).alias("model"), F.lit(pos).alias("pos"), "*", F.lit(built).alias("index_seconds"), F.lit(took).alias("seconds"))
        rows = got if rows is None else rows.union(got)
    rows = frozen(rows)
    reports.write(reports.table(rows, ["model", "hit_rate", "mean_rank", "mrr", "seconds", "index_seconds"], ["pos"], "Models"), "report", [], f"{a.out}/report")
    _show(evaluate.choose(rows))
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, run, *options: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=(run.__doc__ or name).splitlines()[0])
        one.set_defaults(run=run)
        for option in options:
            one.add_argument(f"--{option}", required=True)
        return one

    one = add("address", address)
    one.add_argument("--query")
    one.add_argument("--id")
    one.add_argument("--most", type=int, default=1)
    add("papers", papers, "input", "out")
    one = add("extract", extract, "input", "out")
    one.add_argument("--limit", type=int)
    one.add_argument("--contract", action="store_true", help="metadata that breaks a rule ends the run, rather than going to the quarantine")
    one.add_argument("--batch", help="append to a log of batches, of which each counts once however often it is run")
    one = add("preview", preview, "input")
    one.add_argument("--out")
    one.add_argument("--limit", type=int, default=10)
    one = add("summary", summary, "input")
    one.add_argument("--out")
    one.add_argument("--strict", action="store_true")
    one.add_argument("--without-source", action="store_true")
    add("checklist", checklist, "input", "out").add_argument("--limit", type=int, default=10)
    add("review", review, "input").add_argument("--strict", action="store_true")
    one = add("manifest", manifest, "out")
    one.add_argument("files", nargs="+", metavar="ROLE=PATH")
    one.add_argument("--strict", action="store_true")
    one = add("gate", decide, "input")
    one.add_argument("--reviews", nargs="*", default=[])
    one.add_argument("--allow-unreviewed", action="store_true")
    one.add_argument("--strict", action="store_true")
    one = add("pilot", pilot, "input", "out")
    one.add_argument("--small", action="store_true")
    one.add_argument("--strict", action="store_true")
    one = add("benchmark", benchmark, "first", "second", "out")
    one.add_argument("--workflow", action="store_true")
    one.add_argument("--strict", action="store_true")
    one = add("analyse", analyse, "manifest", "out")
    one.add_argument("--summaries", nargs="*", default=[])
    one.add_argument("--reviews", nargs="*", default=[])
    one.add_argument("--decision", choices=gate.VERDICTS)
    one.add_argument("--strict", action="store_true")
    one = add("dataset", build, "input", "metadata", "domain", "out")
    one.add_argument("--strict", action="store_true")
    one.add_argument("--scaffold", help="questions as JSON lines, in place of the example")
    add("smoke", smoke, "out")
    one = add("parse", parse, "input", "out")
    one.add_argument("--metadata")
    one.add_argument("--folders", help="also write each paper to a folder of its own below this one")
    one = add("second", second, "input", "out")
    one.add_argument("--equations")
    one.add_argument("--question")
    for name, run in (("retrieve", retrieve), ("ask", ask), ("embed", embed)):
        one = add(name, run, "chunks", "questions", "out")
        one.add_argument("--top-k", type=int, nargs="+", default=[5])
        one.add_argument("--baseline", type=float)
        one.add_argument("--retrieval-only", action="store_true")
        one.add_argument("--models", nargs="*")
    return out


def main(argv: list[str] | None = None) -> int:
    """The exit code of a sub-command: 1 if --strict is given and the result isn't the best one."""
    a = parser().parse_args(argv)
    return a.run(SparkSession.builder.appName("quillspark").getOrCreate(), a)
