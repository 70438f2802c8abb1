"""Questions with what was retrieved for them, answers with citations, and summaries of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import records
from .shared import frozen, if_small

# The kinds of errors that answers and retrieval are counted by.
ERRORS = [
    "retrieval_miss", "answer_not_grounded", "wrong_citation", "hallucination", "incomplete_answer", "failed_abstention", "json_or_format_error",
    "backend_error", "empty_context", "unknown_error",
]
# The embedding models known by name: dimension, prefix of queries, prefix of passages.
MODELS = {
    "all-MiniLM-L6-v2": ("sentence-transformers/all-MiniLM-L6-v2", 384, "", ""),
    "e5-small-v2": ("intfloat/e5-small-v2", 384, "query: ", "passage: "),
    "bge-m3": ("BAAI/bge-m3", 1024, "", ""),
}
HIT = ["chunk_id", "paper_id", "arxiv_id", "title", "section_heading", "source_type", "text"]


def model_config(name: str) -> tuple[str, int, str, str]:
    """(name, dimension, prefix of queries, prefix of passages) by key or by full name."""
    for key, config in MODELS.items():
        if name.strip() in (key, config[0]):
            return config
    raise ValueError(f"unknown embedding model: {name}")


def with_prefix(text: Column, model: str, kind: str) -> Column:
    if kind not in ("query", "passage"):
        raise ValueError("a text is a query or a passage")
    return F.concat(F.lit(model_config(model)[2 if kind == "query" else 3]), F.coalesce(text, F.lit("")))


def embedding_text(title: Column, section: Column, text: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, section, text)])


def hits(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked(q, rank, doc, score), chunks(doc, and the fields of HIT) -> ranked with them, a label, a preview.

    The ranking, k rows a question, goes to every task unless it is large, so that texts are not exchanged.
    """
    rows = chunks.select("doc", *HIT).join(if_small(frozen(ranked)), "doc").select(*ranked.columns, *HIT)
    return rows.withColumn("citation_label", F.format_string("[C%d]", "rank")).withColumn("score", F.round("score", 8)).withColumn("text_preview", T.preview(F.col("text")))


def contexts(questions: DataFrame, found: DataFrame, expected: DataFrame) -> DataFrame:
    """questions(q, question, ...) with retrieved (k structs by rank), has_expected, hit, hit_rank, reciprocal_rank.

    expected(q, field, value): value is one of field's values that counts as a hit, where field is chunk_id, paper_id
    or arxiv_id. A question without expectations never hits. One without hits has an empty array.
    """
    own = F.struct("rank", "citation_label", *HIT, "score", "text_preview")
    lists = found.groupBy("q").agg(F.array_sort(F.collect_list(own)).alias("retrieved"))
    keys = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("chunk_id", "paper_id", "arxiv_id")]))
    wanted = expected.where("value IS NOT NULL AND value <> ''").select("q", "field", F.col("value").cast("string").alias("value")).distinct()
    met = found.select("q", "rank", keys.alias("k")).select("q", "rank", "k.*").join(wanted, ["q", "field", "value"], "left_semi")
    known = wanted.select("q").distinct().withColumn("has_expected", F.lit(True))
    out = questions.join(lists, "q", "left").join(met.groupBy("q").agg(F.min("rank").alias("hit_rank")), "q", "left").join(known, "q", "left")
    empty = F.array().cast(lists.schema["retrieved"].dataType)
    out = out.withColumn("retrieved", F.coalesce("retrieved", empty)).withColumn("has_expected", F.coalesce("has_expected", F.lit(False)))
    return out.withColumn("hit", F.col("hit_rank").isNotNull()).withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)))


def answers(asked: DataFrame, factory=None, temperature: float = 0.0) -> DataFrame:
    """contexts with answer, citations (ids it mentions), status and error_categories; without a model they are skipped.

    factory() makes the model, once a task. A failed call is that row's backend_error and ends nothing else.
    """
    ids = F.transform("retrieved", lambda h: h["chunk_id"])
    none = F.array().cast("array<string>")
    if factory is None:
        out = asked.withColumn("answer", F.lit("")).withColumn("note", F.lit("no model was asked")).withColumn("generation_status", F.lit("skipped_retrieval_only"))
        out = out.withColumn("citations", none).withColumn("error_categories", none)
    else:
        said = asked.withColumn("__a", records.generator(factory, temperature)(records.grounded_prompt(F.col("question"), F.col("retrieved"))))
        failed = F.col("__a.error").isNotNull()
        out = said.withColumn("answer", F.coalesce("__a.text", F.lit(""))).withColumn("note", F.coalesce("__a.error", F.lit("")))
        out = out.withColumn("generation_status", F.when(failed, "backend_error").otherwise("success"))
        out = out.withColumn("citations", mentioned_ids(F.col("answer"), ids)).withColumn("error_categories", F.when(failed, F.array(F.lit("backend_error"))).otherwise(none)).drop("__a")
    return out.withColumn("retrieved_chunk_ids", ids).withColumn("grounding_status", F.lit("not_reviewed"))


def mentioned_ids(answer: Column, ids: Column) -> Column:
    from .evaluate import mentioned

    return F.array_distinct(mentioned(answer, ids))


def answer_summary(answered: DataFrame) -> DataFrame:
    """One row: questions, expectations, hits, hit rate (0 without expectations), answers attempted, given and failed."""
    status, expected = F.col("generation_status"), F.count_if("has_expected")
    return answered.agg(
        F.count("*").alias("questions_total"), expected.alias("expected_questions"), F.count_if("hit").alias("hits"),
        F.round(F.coalesce(F.count_if("hit") / F.nullif(expected, F.lit(0)), F.lit(0.0)), 6).alias("hit_rate"),
        F.count_if(status != "skipped_retrieval_only").alias("attempted"), F.count_if(status == "success").alias("succeeded"), F.count_if(status == "backend_error").alias("backend_errors"),
    )


def error_counts(answered: DataFrame) -> DataFrame:
    """(label, records) of every kind of error: those of the answers, misses, and questions without any context."""
    missed = F.when(F.col("has_expected") & ~F.col("hit"), F.lit("retrieval_miss"))
    empty = F.when(F.size("retrieved") == 0, F.lit("empty_context"))
    kinds = answered.select(F.explode(F.array_compact(F.concat("error_categories", F.array(missed, empty)))).alias("kind"))
    return records.zero_filled(kinds, F.col("kind"), ERRORS, "unknown_error")


def misses(each: DataFrame) -> DataFrame:
    """each(q, k, has_expected, hit) -> (k, q) of questions whose expected source was not among the first k."""
    return each.where("has_expected AND NOT coalesce(hit, false)").select("k", "q")


def best_k(rates: DataFrame, baseline: float | None = None) -> DataFrame:
    """rates(k, hit_rate) -> the k with the highest rate, the smallest on ties, and its distance from the baseline's."""
    best = rates.orderBy(F.desc("hit_rate"), "k").limit(1)
    return best.select("k", "hit_rate", F.lit(baseline is not None).alias("available"), F.round(F.col("hit_rate") - F.lit(baseline).cast("double"), 6).alias("delta"))


def diagnostics(questions: DataFrame, terms: DataFrame, chunk_terms: DataFrame, expected: DataFrame) -> DataFrame:
    """Each question with expected_chunks, best_overlap (terms in common with one of them) and best_chunk.

    terms(q, term), chunk_terms(doc, term) are distinct pairs, expected(q, doc). The first chunk by id wins ties; no
    overlap names no chunk.
    """
    laps = expected.join(chunk_terms, "doc").join(terms, ["q", "term"]).groupBy("q", "doc").agg(F.count("*").alias("n"))
    best = laps.groupBy("q").agg(F.max("n").alias("best_overlap"), F.min_by("doc", F.struct(-F.col("n"), "doc")).alias("best_chunk"))
    counts = expected.groupBy("q").agg(F.count("*").alias("expected_chunks"))
    out = questions.select("q").join(counts, "q", "left").join(best, "q", "left")
    return out.withColumn("expected_chunks", F.coalesce("expected_chunks", F.lit(0))).withColumn("best_overlap", F.coalesce("best_overlap", F.lit(0)))


def citation_summary(checked: DataFrame) -> DataFrame:
    """checked(status, ...) -> (status, records, all_valid)."""
    counts = checked.groupBy("status").agg(F.count("*").alias("records"))
    bad = checked.agg((F.count_if(F.coalesce(F.col("status") != "valid", F.lit(True))) == 0).alias("all_valid"))
    return counts.crossJoin(F.broadcast(bad))


class CitingModel:
    """A model without a model: it points to the first chunk of its context and fails on questions that hold a word."""

    def __init__(self, fails_on: str | None = None):
        self.fails_on = fails_on

    def generate(self, prompt: str, temperature: float = 0.0) -> str:
        question, _, context = prompt.partition("Question:\n")[2].partition("\n\nContext:\n")
        if self.fails_on and self.fails_on in question.split():
            raise RuntimeError("no answer")
        named = [line[len("chunk_id: ") :] for line in context.split("\n") if line.startswith("chunk_id: ")]
        return f"As {named[0]} says." if named else "The context does not say."
