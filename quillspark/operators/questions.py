"""The question table of a dataset: what is asked of which papers, and how an answer is judged. What is asked is data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Papers that questions are about, the first ones in order.
PAPERS = 5
# The kinds of questions.
KINDS = ["method", "limitation", "comparison", "definition", "source_lookup", "unanswerable"]
#: A scaffold's columns: at and fallback are places among the first papers, from 1.
SCAFFOLD = "question_id string, question string, question_type string, at array<int>, fallback array<int>, expected_section_keywords array<string>, evaluation_criteria string, notes string"


def example(spark: SparkSession, number: int = 8) -> DataFrame:
    """A scaffold to begin with: one question a kind in turn, about one paper, or two where they are compared."""
    rows = []
    for n in range(number):
        kind, first = KINDS[n % len(KINDS)], n % PAPERS + 1
        at = [first, first % PAPERS + 1] if kind == "comparison" else [first]
        about = " and ".join(f"paper {k}" for k in at)
        judged = "The answer says that the papers don't tell." if kind == "unanswerable" else "The answer cites a passage of each paper it is about."
        rows.append((f"q{n + 1:03d}", f"Give the {kind.replace('_', ' ')} for {about}.", kind, at, [1], kind.split("_"), judged, f"Made by rule, number {n + 1}."))
    return spark.createDataFrame(rows, SCAFFOLD)


def table(papers: DataFrame, scaffold: DataFrame | None = None, order: str = "paper_id") -> DataFrame:
    """papers(paper_id, arxiv_id), scaffold (see SCAFFOLD) -> question_id, question, question_type, expected_source_arxiv_ids,
    expected_section_keywords, evaluation_criteria, notes.

    A question about papers that are not there falls back to others: a comparison needs all of its papers, any other kind one of
    them. A kind that is not known ends the query with an error. Without a scaffold, example() is taken.
    """
    first = papers.select(order, "arxiv_id").orderBy(order).limit(PAPERS).collect()  # never more than PAPERS rows
    ids = F.array(*[F.lit(r["arxiv_id"]).cast("string") for r in first]) if first else F.array().cast("array<string>")
    rows = (example(papers.sparkSession) if scaffold is None else scaffold).withColumn("__ids", ids)
    there = lambda at: F.filter(F.transform(at, lambda i: F.try_element_at("__ids", i)), lambda x: F.coalesce(x, F.lit("")) != "")
    whole = F.when(F.col("question_type") == "comparison", F.array_max("at") <= F.size("__ids")).otherwise(F.array_min("at") <= F.size("__ids"))
    known = F.coalesce(F.col("question_type"), F.lit("")).isin(KINDS)
    kind = F.when(known, F.col("question_type")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of question: "), F.coalesce("question_type", F.lit("null")))).cast("string"))
    return rows.select(
        "question_id", "question", kind.alias("question_type"), F.when(whole, there(F.col("at"))).otherwise(there(F.col("fallback"))).alias("expected_source_arxiv_ids"), "expected_section_keywords",
        F.coalesce("evaluation_criteria", F.lit("")).alias("evaluation_criteria"), F.coalesce("notes", F.lit("")).alias("notes"),
    )
