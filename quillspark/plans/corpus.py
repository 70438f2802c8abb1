"""Queries that audit, chunk, parse and profile the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, chunking, gate, markup, records


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.lit(0).alias("pos"), "text")
    got = chunking.windows(docs)
    return got.select(F.col("paper_id").alias("doc_id"), "chunk_no", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size(T.words(F.col("text"))).cast("long").alias("words"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the id stands for the paper, the source for the title, the language for the section."""
    docs = _t(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("pos"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").cast("string").alias("paper_id"),
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("a"), F.col("doc_id").cast("string"))).alias("arxiv_id"), F.col("source").alias("title"), F.col("lang").alias("section"),
        F.when(F.col("doc_id") % 11 == 0, "figure").otherwise("section").alias("source_type"), F.lit("s").alias("section_id"), F.col("lang").alias("section_heading"), "text", "n_chars",
    )


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as the known papers, and some that have no chunk."""
    rows = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("arxiv_id"), F.concat(F.lit("paper "), F.col("doc_id").cast("string")).alias("title"))
    extra = rows.where("pos % 10 = 0").select("pos", F.concat(F.lit("x"), "paper_id").alias("paper_id"), F.concat(F.lit("x"), "arxiv_id").alias("arxiv_id"), "title")
    return rows.union(extra)


def chunk_audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audit.with_flags(_chunks(spark, sf_dir), _papers(spark, sf_dir))
    return got.select(F.col("pos").alias("doc_id"), F.array_join("quality_flags", ",").alias("flags"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.flag_counts(audit.with_flags(_chunks(spark, sf_dir), _papers(spark, sf_dir)))


def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every paper too, which here is a document."""
    return audit.corpus_audit(audit.with_flags(_chunks(spark, sf_dir), _papers(spark, sf_dir)))


def chunk_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths by section, which here is the language, from the audit."""
    chunks = _chunks(spark, sf_dir).withColumn("quality_flags", F.array().cast("array<string>"))
    got = audit.corpus_audit(chunks).where("dimension = 'section'")
    return got.select(F.nullif("value", F.lit("<missing>")).alias("lang"), "chunks", "least", "mean", "median", "most")


def chunk_v1_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source as the chunks of one paper: running ids by position, resolved titles."""
    docs = _t(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("pos"), F.col("source").alias("paper_id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("arxiv_id"), F.concat(F.lit(" "), "lang", F.lit(" Details / "), "source").alias("section"))
    got = audit.with_v1_ids(audit.resolve_papers(chunks, _papers(spark, sf_dir)))
    return got.select(F.col("pos").alias("doc_id"), F.col("chunk_id_v1").alias("chunk_id"), "section_normalized", F.coalesce("paper_title", F.lit("")).alias("title"))


def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.when(F.col("pos") % 13 == 0, F.lit(None)).when(F.col("pos") % 17 == 0, F.lit(1)).otherwise(T.word_count(F.col("text")))
    return _validated(spark, sf_dir, count)


def _with_metadata(spark: SparkSession, sf_dir: str, count: Column) -> DataFrame:
    """Chunks whose metadata lack one field or another, or are not there."""
    some = {f: F.when(F.col("pos") % (n + 7) == 0, " ").otherwise("x") for n, f in enumerate(audit.REQUIRED_METADATA)}
    own = F.when(F.col("pos") % 19 > 0, F.create_map(*[x for k, v in some.items() for x in (F.lit(k), v)]))
    return _chunks(spark, sf_dir).withColumn("word_count", count.cast("long")).withColumn("metadata", own)


def chunk_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each required field is missing; the column title is missing altogether."""
    return audit.missing_counts(_with_metadata(spark, sf_dir, F.when(F.col("pos") % 13 > 0, 1)).drop("title"))


def chunk_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _with_metadata(spark, sf_dir, F.lit(1))
    return audit.quality_counts(chunks, _papers(spark, sf_dir).withColumn("parsing_status", F.when(F.col("pos") % 3 > 0, "success")))


def chunk_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chunk_warnings(_chunks(spark, sf_dir))


def _validated(spark: SparkSession, sf_dir: str, count: Column) -> DataFrame:
    got = audit.validate_chunks(_with_metadata(spark, sf_dir, count), _papers(spark, sf_dir))
    return got.withColumn("median_words", F.col("median_words").cast("double"))


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_texts(_t(spark, sf_dir, "documents"), "doc_id")


def papers_without_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.without_chunks(_chunks(spark, sf_dir), _papers(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.with_flags(_chunks(spark, sf_dir), _papers(spark, sf_dir)).where("array_contains(quality_flags, 'orphan_chunk')").select("chunk_id")


def sections_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = markup.lines(_t(spark, sf_dir, "documents"))
    return got.select("doc_id", "no", "start", "next_start", F.md5(F.col("line").cast("binary")).alias("line_md5"))


def markup_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(markup.html_text(F.col("html")).cast("binary")).alias("text_md5"))


def markup_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.html_sections(_t(spark, sf_dir, "pages"))


def latex_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, wrapped in markup by SQL functions, parsed back: each line is a section with an equation behind it."""
    docs = _t(spark, sf_dir, "documents")
    line = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("\\section{Part "), (i + 1).cast("string"), F.lit("}\n"), F.regexp_replace(x, r"[\\${}%~&#^_]", ""), F.lit("\n\\[ x = "), i.cast("string"), F.lit(" \\]\n% note\n")))
    source = docs.select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("\\documentclass{article}\\begin{document}\n"), F.array_join(line, ""), F.lit("\\end{document}\n")).alias("text"))
    source = source.withColumn("text", markup.strip_comments(F.col("text")))
    found = markup.equations(source)
    parts = markup.sections(source.withColumn("text", markup.with_placeholders(F.col("text"))))
    linked = markup.equation_sections(found, parts).groupBy("paper_id", "section_id").agg(F.count("*").alias("equations"))
    got = parts.join(linked, ["paper_id", "section_id"], "left")
    return got.select(F.col("paper_id").alias("doc_id"), "section_id", "level", "heading", "equations", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    return records.histogram(events, {"event_type": F.col("event_type"), "has_props": (~T.blank(F.col("props"))).cast("string")})


def json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """props of each event as a record: its keys against the expected one."""
    events = _t(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    status = F.when(F.try_parse_json("props").isNull(), "invalid").when(F.size(F.array_except(F.array(F.lit("k")), keys)) > 0, "missing field").when(F.size(F.array_except(keys, F.array(F.lit("k")))) > 0, "unknown field").otherwise("valid")
    return events.groupBy(status.alias("status")).agg(F.count("*").alias("records"))


def status_histogram_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.zero_filled(_t(spark, sf_dir, "events"), F.col("event_type"), ["click", "view", "purchase", "signup", "error", "unknown"], "unknown")


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty shares of each source's labels as manual reviews, not all of whose records are checked; then their verdicts."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "source", F.when(F.col("doc_id") % 7 > 0, "lang").alias("lang")).join(labels, "doc_id")
    rows = rows.withColumn("source", F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")))
    per = rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("reject"), F.count_if(F.col("quality") == 0).alias("revise"), F.count_if(F.col("lang").isNull()).alias("unchecked"))
    status = gate.review_status(F.col("total"), F.col("total") - F.col("reject") - F.col("revise"), F.col("reject"), F.col("revise"), F.col("total"))
    return per.select("source", "total", "reject", "revise", gate.summary_verdict(status, F.col("total"), F.col("reject"), F.col("total") - F.col("unchecked")).alias("verdict"))


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate("ACCEPT", gate_verdict(spark, sf_dir).select("verdict"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next one of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = _t(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("answer_role", F.lead("role").over(w))
    rows = rows.where("role = 'user' AND answer_role = 'assistant'")
    return rows.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("question_md5"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: size, digest, whether anything is missing."""
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.octet_length("html").cast("long").alias("size_bytes"), F.sha2("html", 256).alias("sha256"), F.col("html").isNotNull().alias("exists"))


def top_docs_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    rows = _t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).cast("long").alias("rank"))
    return rows.where("rank <= 3")


def fake_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic model's answer, parsed and validated again."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", records.fake_extraction(F.col("source")).alias("answer"))
    record = records.parse_model_json(F.concat(F.lit("```json\n"), "answer", F.lit("\n```")))
    docs = docs.withColumn("record", record).withColumn("keys", F.json_object_keys("answer"))
    error = records.extraction_error(F.col("record"), F.col("keys"))
    get = lambda f: F.try_variant_get("record", f"$.{f}", "string")
    return docs.select("doc_id", get("title").alias("title"), get("confidence").alias("confidence"), error.isNull().alias("valid"))


def noisy_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with equal keys, text around them, braces in strings, nested objects, further objects, and some cut short."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))).alias("j"), F.coalesce("source", F.lit("")).alias("source"))
    said = F.regexp_extract("j", r'(?s)^\{"t":(.*)\}$', 1)  # the whole text as a JSON string
    twice = F.concat(F.lit('{"title": "first", "n": {"a": 1, "a": {"b": "} {"}}, "said": '), said, F.lit(', "title": "'), "source", F.lit('"}'))
    case = F.col("doc_id") % 5
    answer = (
        F.when(case == 0, F.concat(F.lit("Here it is: "), twice, F.lit(' or {"title": "later"}'))).when(case == 1, F.concat(F.lit("```json\n"), twice, F.lit("\n```")))
        .when(case == 2, F.substring(twice, 1, 60)).when(case == 3, F.concat(F.lit('{"title": "'), "source", F.lit('", "said": '), said, F.lit("} }} tail"))).otherwise(F.lit("nothing { here"))
    )
    rows = docs.select("doc_id", records.parse_model_json(answer).alias("record"))
    get = lambda f: F.try_variant_get("record", f"$.{f}", "string")
    return rows.select("doc_id", get("title").alias("title"), get("n.a.b").alias("inner"), F.md5(get("said").cast("binary")).alias("said_md5"), F.array_join(F.array_sort(T.object_keys(F.col("record"))), ",").alias("keys"))


def normalized_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(" arXiv:http://x.org/abs/"), F.col("page_id").cast("string"), F.lit(".v1.pdf ")).alias("raw"))
    return pages.select("page_id", T.paper_key(F.col("raw")).alias("key"), T.safe_paper_id(F.col("raw")).alias("safe"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.shorten(F.col("text"), 40).alias("short"))


WORD_SQL = r"[\pL\pN_](?:[\pL\pN\pM_''-]*[\pL\pN\pM_])?"
PAPERS_SQL = """papers AS (
  SELECT doc_id AS pos, doc_id::VARCHAR AS paper_id, 'a' || doc_id AS arxiv_id, 'paper ' || doc_id AS title FROM labels
  UNION ALL SELECT doc_id, 'x' || doc_id, 'xa' || doc_id, 'paper ' || doc_id FROM labels WHERE doc_id % 10 = 0)"""
NORM_SQL = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"
FLAGS_SQL = f"""
WITH {PAPERS_SQL}, d AS (SELECT *, count(*) OVER (PARTITION BY {NORM_SQL}) AS copies FROM documents),
f AS (SELECT doc_id, list_filter([
  CASE WHEN trim(text) = '' THEN 'empty_text' END, CASE WHEN doc_id % 5 = 0 THEN 'missing_arxiv_id' END,
  CASE WHEN doc_id % 11 = 0 THEN 'unknown_source_type' END, CASE WHEN trim(text) <> '' AND length(text) < 80 THEN 'very_short_text' END,
  CASE WHEN length(text) > 2500 THEN 'very_long_text' END, CASE WHEN doc_id::VARCHAR NOT IN (SELECT paper_id FROM papers) THEN 'orphan_chunk' END,
  CASE WHEN trim(text) <> '' AND copies > 1 THEN 'duplicate_text_candidate' END], lambda x: x IS NOT NULL) AS flags FROM d)"""

QUERIES = {
    f.__name__: f
    for f in (
        word_count, chunk_windows, chunk_audit_flags, audit_summary, corpus_audit, chunk_length_stats, chunk_v1_ids, chunk_validation, chunk_missing_fields, chunk_quality_counts, chunk_warnings, duplicate_texts, papers_without_chunks,
        orphans, sections_by_line, markup_clean, markup_sections, latex_sections, record_summary, json_contract, status_histogram_zero_filled, gate_verdict,
        gate_decision, qa_pairs, file_manifest, top_docs_per_source, fake_extraction, noisy_extraction, normalized_ids, previews,
    )
}

VERDICT_SQL = """SELECT d.source || '/' || (doc_id % 50) AS source, count(*) AS total, count_if(toxic = 1)::BIGINT AS reject, count_if(quality = 0)::BIGINT AS revise,
CASE WHEN count_if(toxic = 1) > 0 THEN 'REJECT' WHEN count_if(quality = 0) > 0 OR count_if(doc_id % 7 = 0) > 0 THEN 'REVISE' ELSE 'ACCEPT' END AS verdict
FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL"""

_META = "CASE WHEN doc_id % 19 > 0 THEN " + " + ".join(f"CASE WHEN doc_id % {n + 7} = 0 THEN 1 ELSE 0 END" for n in range(len(audit.REQUIRED_METADATA))) + " ELSE 1 END"
_LACKING = {
    "arxiv_id": "doc_id % 5 = 0", "text": "trim(text) = ''", "metadata": "doc_id % 19 = 0",
    **{f"metadata.{f}": f"doc_id % 19 > 0 AND doc_id % {n + 7} = 0" for n, f in enumerate(audit.REQUIRED_METADATA)},
}


def _missing_sql(lacking: dict[str, str], twice: str | None = None) -> str:
    parts = [f"SELECT '{f}' AS field, count_if({test})::BIGINT AS chunks FROM documents" for f, test in lacking.items()]
    parts += [f"SELECT 'word_count', 2 * count_if({twice})::BIGINT FROM documents"] if twice else []
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE chunks > 0"


ORACLES = {
    "word_count": f"SELECT doc_id, len(regexp_extract_all(text, '{WORD_SQL}')) AS words FROM documents",
    "chunk_windows": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT *, len(w) AS n, greatest(0, ceil((len(w) - 400 - 80 + 1) / 340.0))::BIGINT AS last FROM d WHERE len(w) > 0),
k AS (SELECT *, unnest(range(0, last + 1)) AS k FROM n),
c AS (SELECT doc_id, k + 1 AS chunk_no, list_slice(w, k * 340 + 1, CASE WHEN k = last THEN n ELSE k * 340 + 400 END) AS part FROM k)
SELECT doc_id, chunk_no, md5(array_to_string(part, ' ')) AS text_md5, len(part)::BIGINT AS words FROM c""",
    "chunk_audit_flags": FLAGS_SQL + " SELECT doc_id, array_to_string(flags, ',') AS flags FROM f",
    "audit_summary": FLAGS_SQL + ", e AS (SELECT unnest(flags) AS flag FROM f) SELECT flag, count(*) AS chunks FROM e GROUP BY flag",
    "corpus_audit": FLAGS_SQL + """, c AS (
  SELECT d.doc_id::VARCHAR AS paper, d.lang AS section, CASE WHEN d.doc_id % 11 = 0 THEN 'figure' ELSE 'section' END AS kind, coalesce(length(text), 0) AS size, unnest(list_concat([NULL], flags)) AS flag FROM documents d JOIN f USING (doc_id)),
g AS (SELECT paper, coalesce(nullif(trim(section), ''), '<missing>') AS section, kind, flag, size, flag IS NULL AS whole FROM c),
s AS (SELECT grouping(paper, section, kind, flag) AS k, paper, section, kind, flag, count(*) FILTER (whole) AS n0, count(*) FILTER (NOT whole) AS n1, min(size) FILTER (whole) AS a0, min(size) FILTER (NOT whole) AS a1,
  avg(size) FILTER (whole) AS m0, avg(size) FILTER (NOT whole) AS m1, median(size) FILTER (whole) AS h0, median(size) FILTER (NOT whole) AS h1, max(size) FILTER (whole) AS z0, max(size) FILTER (NOT whole) AS z1
  FROM g GROUP BY GROUPING SETS ((paper), (section), (kind), (flag), ()))
SELECT CASE k WHEN 7 THEN 'paper' WHEN 11 THEN 'section' WHEN 13 THEN 'source_type' WHEN 14 THEN 'flag' ELSE 'all' END AS dimension, coalesce(paper, section, kind, flag, '') AS value, CASE WHEN k = 14 THEN n1 ELSE n0 END AS chunks,
  CASE WHEN k = 14 THEN a1 ELSE a0 END AS least, round(CASE WHEN k = 14 THEN m1 ELSE m0 END, 4) AS mean, CASE WHEN k = 14 THEN h1 ELSE h0 END AS median, CASE WHEN k = 14 THEN z1 ELSE z0 END AS most
FROM s WHERE CASE WHEN k = 14 THEN n1 ELSE n0 END > 0""",
    "chunk_length_stats": "SELECT lang, count(*) AS chunks, min(length(text)) AS least, round(avg(length(text)), 4) AS mean, median(length(text)) AS median, max(length(text)) AS most FROM documents GROUP BY lang",
    "chunk_v1_ids": f"""WITH {PAPERS_SQL}, p AS (SELECT * FROM papers),
c AS (SELECT d.doc_id, coalesce(p.paper_id, d.source) AS paper, d.lang, d.source, coalesce(p.title, '') AS title FROM documents d LEFT JOIN p ON p.arxiv_id = 'a' || d.doc_id)
SELECT doc_id, paper || '::chunk_v1::' || printf('%04d', row_number() OVER (PARTITION BY paper ORDER BY doc_id)) AS chunk_id,
       trim(regexp_replace(lower(trim(' ' || lang || ' Details / ' || source)), '[^a-z0-9]+', '_', 'g'), '_') AS section_normalized, title FROM c""",
    "chunk_validation": f"""WITH {PAPERS_SQL}, ids AS (SELECT DISTINCT paper_id FROM papers),
c AS (SELECT doc_id, doc_id::VARCHAR AS paper_id, text, len(regexp_extract_all(text, '{WORD_SQL}')) AS actual FROM documents),
w AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 1 ELSE actual END AS word_count FROM c),
m AS (SELECT count(*) AS chunks, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN word_count IS NULL THEN 2 ELSE 0 END + {_META})::BIGINT AS missing_fields,
  count_if(paper_id NOT IN (SELECT paper_id FROM ids))::BIGINT AS orphan_chunks, count_if(trim(text) = '')::BIGINT AS empty_chunks, count_if(doc_id % 11 = 0)::BIGINT AS invalid_types,
  count_if(abs(word_count - actual) > greatest(3, floor(actual * 0.2)))::BIGINT AS word_count_mismatch, min(word_count) AS min_words, median(word_count) AS median_words, max(word_count) AS max_words FROM w),
x AS (SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS duplicate_ids,
  (SELECT count(*) FROM ids WHERE paper_id NOT IN (SELECT paper_id FROM c)) AS papers_without_chunks)
SELECT m.*, x.*, CASE WHEN orphan_chunks > 0 OR empty_chunks > 0 OR duplicate_ids > 0 OR missing_fields > 0 THEN 'FAIL'
  WHEN papers_without_chunks > 0 OR invalid_types > 0 OR word_count_mismatch > 0 THEN 'REVISE' ELSE 'PASS' END AS status FROM m, x""",
    "chunk_missing_fields": _missing_sql(_LACKING | {"title": "true"}, "doc_id % 13 = 0"),
    "chunk_warnings": "SELECT 'd' || doc_id AS chunk_id, 'invalid source_type figure' AS warning FROM documents WHERE doc_id % 11 = 0",
    "chunk_quality_counts": f"""WITH {PAPERS_SQL}
SELECT 'chunks_per_paper' AS topic, doc_id::VARCHAR AS name, count(*) AS number FROM documents GROUP BY doc_id
UNION ALL SELECT 'source_type_counts', CASE WHEN doc_id % 11 = 0 THEN 'figure' ELSE 'section' END, count(*) FROM documents GROUP BY ALL
UNION ALL SELECT 'missing_field_counts', field, chunks FROM ({_missing_sql(_LACKING)})
UNION ALL SELECT 'parsing_status_counts', CASE WHEN pos % 3 > 0 THEN 'success' ELSE '<missing>' END, count(*) FROM papers GROUP BY ALL""",
    "duplicate_texts": f"SELECT md5({NORM_SQL}) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "papers_without_chunks": f"WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE paper_id NOT IN (SELECT doc_id::VARCHAR FROM documents)",
    "orphans": f"WITH {PAPERS_SQL} SELECT 'd' || doc_id AS chunk_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT paper_id FROM papers)",
    "sections_by_line": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
s AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - length(line) - 1)::BIGINT AS start FROM l)
SELECT doc_id, no, start, lead(start) OVER (PARTITION BY doc_id ORDER BY no) AS next_start, md5(line) AS line_md5 FROM s""",
    "markup_clean": r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
  '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""",
    "record_summary": """SELECT 'event_type' AS field, coalesce(nullif(event_type, ''), '<missing>') AS value, count(*) AS records FROM events GROUP BY ALL
UNION ALL SELECT 'has_props', CASE WHEN trim(coalesce(props, '')) <> '' THEN 'true' ELSE 'false' END, count(*) FROM events GROUP BY ALL""",
    "json_contract": """SELECT CASE WHEN NOT coalesce(json_valid(props), false) THEN 'invalid' WHEN NOT list_contains(json_keys(props), 'k') THEN 'missing field'
WHEN len(json_keys(props)) > 1 THEN 'unknown field' ELSE 'valid' END AS status, count(*) AS records FROM events GROUP BY 1""",
    "status_histogram_zero_filled": """WITH l AS (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error', 'unknown']) AS label)
SELECT l.label, (SELECT count(*) FROM events e WHERE CASE WHEN e.event_type IN ('click', 'view', 'purchase', 'signup', 'error', 'unknown') THEN e.event_type ELSE 'unknown' END = l.label) AS records FROM l""",
    "gate_verdict": VERDICT_SQL,
    "gate_decision": f"SELECT CASE max(CASE verdict WHEN 'ACCEPT' THEN 1 WHEN 'REVISE' THEN 2 ELSE 3 END) WHEN 1 THEN 'ACCEPT' WHEN 2 THEN 'REVISE' ELSE 'REJECT' END AS decision, count(*) AS reviews FROM ({VERDICT_SQL})",
    "qa_pairs": """WITH c AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS answer_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, md5(text) AS question_md5, md5(answer) AS answer_md5 FROM c WHERE role = 'user' AND answer_role = 'assistant'""",
    "file_manifest": "SELECT page_id, url, strlen(html)::BIGINT AS size_bytes, sha256(html) AS sha256, html IS NOT NULL AS \"exists\" FROM pages",
    "top_docs_per_source": "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3",
    "fake_extraction": "SELECT doc_id, source AS title, 'medium' AS confidence, true AS valid FROM documents",
    "noisy_extraction": """SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 3) THEN coalesce(source, '') END AS title, CASE WHEN doc_id % 5 IN (0, 1) THEN '} {' END AS inner,
CASE WHEN doc_id % 5 IN (0, 1, 3) THEN md5(coalesce(text, '')) END AS said_md5, CASE WHEN doc_id % 5 IN (0, 1) THEN 'n,said,title' WHEN doc_id % 5 = 3 THEN 'said,title' END AS keys FROM documents""",
    "normalized_ids": "SELECT page_id, page_id || '.v1' AS key, page_id || '_v1' AS safe FROM pages",
    "previews": r"""WITH w AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, substr(t, 1, 280) AS preview, CASE WHEN length(t) <= 40 THEN t ELSE rtrim(substr(t, 1, 37)) || '...' END AS short FROM w""",
}
