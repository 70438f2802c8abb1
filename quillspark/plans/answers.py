"""Queries over retrieved contexts, answers, datasets in both forms and review sheets, with their SQL."""

from __future__ import annotations

from functools import partial

import gzip
import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import audit, dataset, gate, reports
from ..operators import evaluate as E
from ..operators import retrieval as R
from ..operators.shared import frozen, if_small
from . import corpus
from . import retrieval as P

#: Questions with this word get no answer from the model of these queries.
REFUSED = "the"
BASELINE = 0.5


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items, their five best documents, and the documents that hold them as what is expected."""
    docs, questions = P._docs(spark, sf_dir), P._questions(spark, sf_dir)
    ranked = R.retrieve(P.index_of(spark, sf_dir), questions, T.tokens_v0(F.col("question")), P.K)
    chunks = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("doc"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("paper_id"), F.lit("").alias("arxiv_id"), F.col("source").alias("title"),
        F.col("lang").alias("section_heading"), F.lit("section").alias("source_type"), "text",
    )
    expected = P._expected(spark, sf_dir).select("q", F.lit("chunk_id").alias("field"), F.concat(F.lit("doc"), F.col("doc").cast("string")).alias("value"))
    return A.contexts(questions, A.hits(ranked, chunks), expected)


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.answers(_asked(spark, sf_dir), partial(A.CitingModel, REFUSED))


def retrieved_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda f: F.array_join(F.transform("retrieved", f), ",")
    return _asked(spark, sf_dir).select(F.col("q").alias("item_id"), join(lambda h: h["citation_label"]).alias("labels"), join(lambda h: h["chunk_id"]).alias("chunks"), "has_expected", "hit", "hit_rank", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select(F.col("q").alias("item_id"), "generation_status", F.array_join("citations", ",").alias("citations"), F.array_join("error_categories", ",").alias("errors"))


def answers_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval alone: no model is asked."""
    return A.answer_summary(A.answers(_asked(spark, sf_dir)))


def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.answer_summary(_answered(spark, sf_dir))


def answer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.error_counts(_answered(spark, sf_dir))


def missed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.misses(E.at_each_k(P._graded(spark, sf_dir), P.KS)).withColumnRenamed("q", "item_id")


def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best_k(P.hit_rate_by_k(spark, sf_dir), BASELINE)


def overlap_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, questions = P._docs(spark, sf_dir), P._questions(spark, sf_dir)
    terms = questions.select("q", F.explode(F.array_distinct(T.tokens_v1(F.col("question")))).alias("term"))
    expected = frozen(P._expected(spark, sf_dir))
    held = docs.join(if_small(frozen(expected.select("doc").distinct())), "doc", "left_semi")
    chunk_terms = held.select("doc", F.explode(F.array_distinct(T.tokens_v1(F.col("text")))).alias("term"))
    return A.diagnostics(questions, terms, chunk_terms, expected).withColumnRenamed("q", "item_id")


def citation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.citation_summary(P.citation_check(spark, sf_dir))


def dataset_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as papers, some of them failed; their texts as chunks of the first form."""
    papers = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("arxiv_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("paper "), F.col("doc_id").cast("string"))).otherwise("").alias("title"),
        F.element_at(F.array(F.lit("success"), F.lit("partial"), F.lit("failed")), (F.col("doc_id") % 3 + 1).cast("int")).alias("parsing_status"), F.lit("latex_source").alias("source_type"), F.concat(F.lit("papers/"), F.col("doc_id").cast("string")).alias("paper_dir"),
    )
    got = dataset.chunks_v0(corpus._chunks(spark, sf_dir).withColumn("word_count", T.word_count(F.col("text"))), papers, "prose", "documents")
    return got.select("chunk_id", "arxiv_id", "title", "word_count", F.col("metadata")["source_file"].alias("source_file"), F.col("metadata")["parsing_status"].alias("parsing_status"))


def dataset_chunks_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dataset.chunks_v1(corpus._chunks(spark, sf_dir), corpus._papers(spark, sf_dir))
    return got.select(F.col("pos").alias("doc_id"), "chunk_id", "arxiv_id", "title", "source_type", "text_length_chars", "text_length_tokens_est", F.array_join("quality_flags", ",").alias("flags"), F.col("source_refs.paper_record_available").alias("known"))


def chunk_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.id_map(dataset.chunks_v1(corpus._chunks(spark, sf_dir), corpus._papers(spark, sf_dir)))


def running_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered within their source, by slices of a thousand ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return audit.numbered(docs, "source", "doc_id", 1000).withColumnRenamed("__n", "n")


def parse_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as marked-up files: some without equation, some without heading or words, all beside a style file larger than they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("paper_id"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\\{}%$~]", " ").alias("t"))
    main = docs.select("paper_id", F.lit("src/main.tex").alias("path"), F.lit("\\documentclass{a}\\begin{document}\\input{body}\\input{lost}\\end{document}").alias("text"))
    heading, equation = F.when(F.col("doc_id") % 5 == 1, "").otherwise("\\section{Body}\n"), F.when(F.col("doc_id") % 3 == 1, "").otherwise("\n\\[ e = 1 \\]\n")
    words = F.when(F.col("doc_id") % 5 == 2, "").otherwise(F.col("t"))
    body = docs.select("paper_id", F.lit("src/body.tex").alias("path"), F.concat(heading, words, F.when(F.col("doc_id") % 5 == 2, "").otherwise(equation)).alias("text"))
    style = docs.select("paper_id", F.lit("src/big.sty").alias("path"), F.concat(F.lit("\\documentclass \\begin{document}"), F.repeat(F.lit("x"), 400)).alias("text"))
    got = dataset.parsed(dataset.flattened(main.union(body).union(style)))["papers"]
    return got.select(F.col("paper_id").cast("long").alias("doc_id"), "sections_count", "equations_count", "parsing_status", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def parse_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as downloads: archives whose files include each other, in a circle too, compressed files, PDF, pages, broken archives; some without metadata."""

    def pack(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for text, kind in zip(texts, kinds):
            body = f"\\section{{Body}}\n{text}\n\\[ e = 1 \\]\n\\include{{main}}"
            files = {"a/main.tex": "\\documentclass{a}\\begin{document}\\input{one}\\input{two}\\input{lost}\\end{document}", "a/one.tex": "\\input{two}", "a/two.tex": body, "a/odd.png": "x"}
            held = io.BytesIO()
            with tarfile.open(fileobj=held, mode="w:gz") as archive:
                for name, said in files.items():
                    entry = tarfile.TarInfo(name)
                    entry.size = len(said.encode())
                    archive.addfile(entry, io.BytesIO(said.encode()))
            whole = gzip.compress(f"\\documentclass{{a}}\\begin{{document}}{body}\\end{{document}}".encode())
            out.append([held.getvalue(), held.getvalue()[: len(held.getvalue()) // 2], b"%PDF-1.4 x", whole, b"<HTML>none</HTML>", held.getvalue()][kind])
        return pd.Series(out)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("paper_id"), "source", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\\{}%$~]", " ").alias("t"))
    blobs = docs.select("paper_id", F.pandas_udf(pack, "binary")("t", (F.col("doc_id") % 6).cast("int")).alias("content"))
    metadata = docs.where("doc_id % 6 <> 5").select(F.concat(F.lit("arXiv:"), "paper_id").alias("arxiv_id"), F.col("source").alias("title"), F.lit("We do.").alias("abstract"))
    got = dataset.parse_sources(blobs, metadata)["papers"]
    return got.select(F.col("paper_id").cast("long").alias("doc_id"), "title", "parsing_status", "sections_count", "equations_count", "plain_text_word_count", F.array_join("errors", ",").alias("errors"), F.array_join(F.array_sort(F.map_keys("files")), ",").alias("files"))


def parsing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events as kinds of errors, most of them unknown."""
    kind = F.when(F.col("event_type") == "error", "pdf_parse_error").otherwise(F.col("event_type"))
    return dataset.parsing_errors(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.array(kind).alias("errors")))


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    record = F.to_variant_object(F.struct(F.struct(F.concat(F.lit("a-"), F.col("doc_id").cast("string")).alias("arxiv_id"), F.col("source").alias("title")).alias("source")))
    return docs.withColumn("sheet", reports.review_section(F.col("doc_id"), record, F.lit("As is.")))


def review_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheets(spark, sf_dir).select("doc_id", F.md5(F.col("sheet").cast("binary")).alias("sheet_md5"))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets as reviewers return them: ticked or not, with outcomes quoted, bare, unknown or left as they were, some with notes."""
    ticked = F.when(F.col("doc_id") % 2 == 0, F.replace("sheet", F.lit("- [ ] "), F.lit("- [x] "))).otherwise(F.col("sheet"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("`pass`", "pass", "`Revise`", " reject ", "passed", "`pass | revise | reject | unclear`")]), (F.col("doc_id") % 6 + 1).cast("int"))
    judged = F.replace(ticked, F.lit(reports.UNDECIDED), F.concat(F.lit("Review outcome: "), said))
    noted = F.when(F.col("doc_id") % 4 == 0, F.replace(judged, F.lit("- [x] Notes:"), F.concat(F.lit("- [x] Notes: see "), F.col("doc_id").cast("string")))).otherwise(judged)
    return gate.review_records(_sheets(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), noted.alias("text")))


def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _reviewed(spark, sf_dir)
    return got.select(F.col("record_index").alias("doc_id"), "title", "arxiv_id", F.when(F.col("record_index") % 4 == 0, F.col("notes")).otherwise("").alias("notes"), "outcome", "fully_checked")


def review_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.review_summary(_reviewed(spark, sf_dir), gate.CHECKS)


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.coalesce("source", F.lit("<missing>")).alias("source")).agg(F.count("*").alias("documents"))
    return reports.table(counts, ["source", "documents"], ["source"], "Sources")


QUERIES = {
    f.__name__: f
    for f in (
        retrieved_contexts, answer_records, answers_skipped, answer_summary, answer_errors, missed_questions, best_k, overlap_diagnostics, citation_summary, dataset_chunks,
        dataset_chunks_v1, chunk_id_map, running_numbers, parse_papers, parse_archives, parsing_errors, review_sheets, review_records, review_round_trip, source_report,
    )
}

# SQL that several queries share.
_ASKED = P._ranked_sql(P.POST0, P.TERMS0, P.QS, P.K) + f""", {P._EXPECTED},
asked AS (
  SELECT b.item_id, list_contains(string_split(b.text, ' '), '{REFUSED}') AS refused, EXISTS (SELECT 1 FROM expected e WHERE e.q = b.item_id) AS has_expected,
         (SELECT min(r.rank) FROM ranked r JOIN expected e ON e.q = r.q AND e.doc = r.doc WHERE r.q = b.item_id) AS hit_rank,
         (SELECT min(r.doc) FROM ranked r WHERE r.q = b.item_id AND r.rank = 1) AS first
  FROM benchmark b
)"""
_SUMMARY = """count(*) AS questions_total, count_if(has_expected)::BIGINT AS expected_questions, count(hit_rank) AS hits,
round(coalesce(count(hit_rank) / nullif(count_if(has_expected), 0), 0), 6) AS hit_rate"""
_V1 = corpus.FLAGS_SQL + """, v AS (
  SELECT doc_id, doc_id || '::chunk_v1::0001' AS chunk_id, CASE WHEN doc_id % 5 > 0 THEN 'a' || doc_id ELSE '' END AS arxiv_id, source AS title,
         CASE WHEN doc_id % 11 = 0 THEN 'unknown' ELSE 'section' END AS source_type, length(text) AS text_length_chars, TOKENS AS text_length_tokens_est,
         array_to_string(list_sort(list_distinct(flags)), ',') AS flags, doc_id::VARCHAR IN (SELECT paper_id FROM papers) AS known
  FROM documents JOIN f USING (doc_id))""".replace("TOKENS", f"len({P.TOK1.format('text')})")
_TICKS = " || chr(10) || ".join(f"'{t}'" for t in reports.TICKS)
_SHEET = f"""'## Record ' || doc_id || ': ' || source || chr(10) || chr(10) || '- arXiv ID: `a-' || doc_id || '`' || chr(10) || '- URL: -' || chr(10) || '- backend/model: `-` / `-`' || chr(10)
|| '- prompt version: `-`' || chr(10) || '- extraction confidence: `-`' || chr(10) || chr(10) || '### Abstract' || chr(10) || chr(10) || 'As is.' || chr(10) || chr(10) || '### Extracted fields' || chr(10) || chr(10)
|| '- `main_claim`: -' || chr(10) || '- `method`: -' || chr(10) || '- `limitations`: -' || chr(10) || chr(10) || '### Checks' || chr(10) || chr(10) || {_TICKS} || chr(10) || chr(10) || '{reports.UNDECIDED}' || chr(10)"""
_OUTCOME = "CASE doc_id % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'pass' WHEN 2 THEN 'revise' WHEN 3 THEN 'reject' ELSE 'unclear' END"

ORACLES = {
    "retrieved_contexts": _ASKED + """SELECT a.item_id, coalesce(string_agg('[C' || r.rank || ']', ',' ORDER BY r.rank), '') AS labels, coalesce(string_agg('doc' || r.doc, ',' ORDER BY r.rank), '') AS chunks,
any_value(has_expected) AS has_expected, any_value(hit_rank) IS NOT NULL AS hit, any_value(hit_rank) AS hit_rank, round(coalesce(1.0 / any_value(hit_rank), 0), 6) AS reciprocal_rank
FROM asked a LEFT JOIN ranked r ON r.q = a.item_id GROUP BY a.item_id""",
    "answer_records": _ASKED + """SELECT item_id, CASE WHEN refused THEN 'backend_error' ELSE 'success' END AS generation_status, CASE WHEN refused THEN '' ELSE 'doc' || first END AS citations,
CASE WHEN refused THEN 'backend_error' ELSE '' END AS errors FROM asked""",
    "answers_skipped": _ASKED + f"SELECT {_SUMMARY}, 0 AS attempted, 0 AS succeeded, 0 AS backend_errors FROM asked",
    "answer_summary": _ASKED + f"SELECT {_SUMMARY}, count(*) AS attempted, count_if(NOT refused)::BIGINT AS succeeded, count_if(refused)::BIGINT AS backend_errors FROM asked",
    "answer_errors": _ASKED + f""", l AS (SELECT unnest({A.ERRORS}) AS label)
SELECT label, CASE label WHEN 'retrieval_miss' THEN (SELECT count(*) FROM asked WHERE has_expected AND hit_rank IS NULL) WHEN 'backend_error' THEN (SELECT count(*) FROM asked WHERE refused) ELSE 0 END AS records FROM l""",
    "missed_questions": P._ranked_sql(P.POST0, P.TERMS0, P.QS, max(P.KS)) + P._GRADED + "SELECT k, q AS item_id FROM each WHERE has_expected AND NOT hit",
    "best_k": P._ranked_sql(P.POST0, P.TERMS0, P.QS, max(P.KS)) + P._GRADED + f"SELECT k, hit_rate, true AS available, round(hit_rate - {BASELINE}, 6) AS delta FROM (SELECT k, {P._METRICS} FROM each GROUP BY k) ORDER BY hit_rate DESC, k LIMIT 1",
    "overlap_diagnostics": f"""WITH {P._EXPECTED},
t AS (SELECT DISTINCT item_id AS q, unnest({P.TOK1.format('text')}) AS term FROM benchmark),
c AS (SELECT DISTINCT doc_id AS doc, unnest({P.TOK1.format('text')}) AS term FROM documents),
laps AS (SELECT q, doc, count(*) AS n FROM expected JOIN c USING (doc) JOIN t USING (q, term) GROUP BY q, doc),
best AS (SELECT q, doc, n FROM laps QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, doc) = 1)
SELECT b.item_id, (SELECT count(*) FROM expected e WHERE e.q = b.item_id) AS expected_chunks, coalesce(best.n, 0) AS best_overlap, best.doc AS best_chunk FROM benchmark b LEFT JOIN best ON best.q = b.item_id""",
    "citation_summary": f"WITH x AS ({P.ORACLES['citation_check']}) SELECT status, count(*) AS records, (SELECT count_if(status <> 'valid') = 0 FROM x) AS all_valid FROM x GROUP BY status",
    "dataset_chunks": f"""SELECT 'd' || d.doc_id AS chunk_id, 'a' || d.doc_id AS arxiv_id, CASE WHEN d.doc_id % 2 = 0 THEN 'paper ' || d.doc_id ELSE d.source END AS title,
len(regexp_extract_all(text, '{corpus.WORD_SQL}')) AS word_count, 'papers/' || d.doc_id || '/chunks.jsonl' AS source_file, CASE d.doc_id % 3 WHEN 0 THEN 'success' ELSE 'partial' END AS parsing_status
FROM documents d JOIN labels USING (doc_id) WHERE d.doc_id % 3 < 2""",
    "dataset_chunks_v1": _V1 + " SELECT * FROM v",
    "chunk_id_map": "SELECT 'd' || doc_id AS old, doc_id || '::chunk_v1::0001' AS new FROM documents",
    "running_numbers": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents",
    "parsing_errors": f"""WITH l AS (SELECT unnest({dataset.ERRORS}) AS label)
SELECT label, (SELECT count(*) FROM events WHERE CASE WHEN event_type = 'error' THEN 'pdf_parse_error' ELSE 'unknown_error' END = label) AS records FROM l""",
    "parse_papers": r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN '' ELSE trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\{}%$~]', ' ', 'g'), '\s+', ' ', 'g')) END AS words,
  CASE WHEN doc_id % 5 = 2 OR doc_id % 3 = 1 THEN 0 ELSE 1 END AS equations_count, doc_id % 5 <> 1 AS headed FROM documents),
t AS (SELECT *, words <> '' OR equations_count = 1 AS filled FROM d),
p AS (SELECT *, CASE WHEN headed OR filled THEN 1 ELSE 0 END AS sections_count FROM t)
SELECT doc_id, sections_count, equations_count, CASE WHEN NOT filled THEN 'failed' WHEN equations_count = 0 THEN 'partial' ELSE 'success' END AS parsing_status,
CASE WHEN filled THEN '' ELSE 'plain_text_empty,chunk_generation_empty' END AS errors,
array_to_string(list_filter([CASE WHEN sections_count = 0 THEN 'section_extraction_weak' END, CASE WHEN equations_count = 0 THEN 'equation_extraction_weak' END], lambda x: x IS NOT NULL), ',') AS warnings FROM p""",
    "parse_archives": r"""WITH d AS (SELECT *, doc_id % 6 IN (0, 3) AS good, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\{}%$~]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN '' ELSE coalesce(nullif(source, ''), doc_id::VARCHAR) END AS title, CASE WHEN good THEN 'success' ELSE 'failed' END AS parsing_status, good::BIGINT AS sections_count, good::BIGINT AS equations_count,
CASE WHEN good THEN len(regexp_extract_all(t, 'WORDS')) + 2 ELSE 0 END AS plain_text_word_count, CASE doc_id % 6 WHEN 1 THEN 'archive_extract_error' WHEN 2 THEN 'pdf_fallback_skipped' WHEN 4 THEN 'source_unavailable' WHEN 5 THEN 'metadata_error' ELSE '' END AS errors,
CASE WHEN good THEN 'chunks,equations,sections' ELSE '' END AS files FROM d""".replace("WORDS", corpus.WORD_SQL),
    "review_sheets": f"SELECT doc_id, md5({_SHEET}) AS sheet_md5 FROM documents",
    "review_records": f"""SELECT doc_id, source AS title, 'a-' || doc_id AS arxiv_id, CASE WHEN doc_id % 4 = 0 THEN 'see ' || doc_id ELSE '' END AS notes, {_OUTCOME} AS outcome, doc_id % 2 = 0 AS fully_checked FROM documents""",
    "review_round_trip": f"""WITH r AS (SELECT {_OUTCOME} AS o, doc_id % 2 = 0 AS done FROM documents)
SELECT count(*) AS total_records, count_if(o = 'pass')::BIGINT AS "pass", count_if(o = 'revise')::BIGINT AS revise, count_if(o = 'reject')::BIGINT AS reject, count_if(o = 'unclear')::BIGINT AS unclear, count_if(done)::BIGINT AS fully_checked,
{", ".join(f"count_if(done)::BIGINT AS {c}" for c in gate.CHECKS)}, 'REVIEW_REJECTED_RECORDS' AS status FROM r""",
    "source_report": """WITH c AS (SELECT coalesce(source, '<missing>') AS source, count(*) AS n FROM documents GROUP BY 1)
SELECT '# Sources' || chr(10) || chr(10) || '| source | documents |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || source || ' | ' || n || ' |', chr(10) ORDER BY source) || chr(10) AS report FROM c""",
}
