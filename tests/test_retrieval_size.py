"""What retrieval writes to disk, and that its ways of scoring agree with all pairs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval
from quillspark.operators.shared import ensure_checkpoint_dir
from quillspark.plans import registry
from quillspark.plans import retrieval as plans

from test_operators import plain_top

SF = "/root/testdata/sf0.01"


def written(spark, run):
    """Bytes that run() shuffles and leaves in the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    held = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)
    store, context = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext

    def shuffled():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return {(stages.apply(n).stageId(), stages.apply(n).attemptId()): stages.apply(n).shuffleWriteBytes() for n in range(stages.size())}

    before, files = shuffled(), held()
    run()
    return sum(n for stage, n in shuffled().items() if stage not in before) + held() - files


@pytest.mark.parametrize(
    "name", ["retrieve_tfidf_v0", "hit_rate_by_k", "hit_rate_by_kind_and_k", "best_k", "missed_questions", "citation_check", "retrieved_contexts", "answer_records", "answers_skipped", "answer_sheets", "debug_sections"]
)
def test_disk_stays_below_the_limit(spark, name):
    """Everything written, also what Spark could delete before the end, is less than 4 times the documents, and 2 MB for the questions' contexts."""
    plans._HELD.clear()
    size = os.path.getsize(f"{SF}/documents.parquet")
    assert written(spark, lambda: registry.QUERIES[name](spark, SF).collect()) < 4 * size + (2 << 20)


@pytest.mark.parametrize(("common", "block", "few"), [(1 << 18, 32 << 20, 1 << 12), (5, 2000, 3)])
def test_all_documents_in_one_pass(spark, monkeypatch, common, block, few):
    """Weights sent or joined, questions in one block or many, documents named or joined: the same best as of all pairs, as by postings."""
    rng = random.Random(8)
    word = lambda: f"w{int(60 ** rng.random() * 3)}"
    docs = [(n, " ".join(word() for _ in range(rng.randrange(1, 60)))) for n in range(300)] + [(500, ""), (501, "w3 w3"), (502, "w3 w3"), (503, "rare w3 w4")]
    questions = [(n, " ".join(word() for _ in range(1 + n % 12))) for n in range(20)] + [(99, "unknown words only"), (100, "rare")]
    want = sorted(plain_top(docs, questions, 4))
    monkeypatch.setattr(retrieval, "COMMON", common), monkeypatch.setattr(retrieval, "QUERY_BLOCK", block), monkeypatch.setattr(retrieval, "FEW_DOCS", few)
    monkeypatch.setattr(retrieval, "BLOCK", 8), monkeypatch.setattr(retrieval, "FIRST_POSTINGS", 10), monkeypatch.setattr(retrieval, "CELLS", 2000), monkeypatch.setattr(retrieval, "TOKENS", 100)
    table, asked = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(questions, "q long, text string")
    for impact, share in ((False, 1.0), (True, 1e9), (True, 0.0)):
        monkeypatch.setattr(retrieval, "LEAST_SCAN", share)
        index = retrieval.build_index(table, F.split("text", " "), impact=impact)
        rows = sorted((r.q, r["rank"], r.doc, r.score) for r in retrieval.retrieve(index, asked, F.split("text", " "), 4).collect())
        assert [r[:3] for r in rows] == [r[:3] for r in want]
        assert all(abs(a[3] - b[3]) < 1e-8 for a, b in zip(rows, want, strict=True))


def test_rows_of_one_document_are_one(spark):
    """Rows of one id add up, as a text in parts; a document without an id counts, but is not found; ids and questions may be texts."""
    rows = [("a", "x y"), ("b", "x"), ("a", "y z"), ("c", None), (None, "x x"), (None, "y")]
    index = retrieval.build_index(spark.createDataFrame(rows, "doc string, text string"), F.split("text", " "), impact=False)
    assert sorted((r.doc or "-", r.term, r.tf) for r in index.postings.collect()) == [("-", "x", 2), ("-", "y", 1), ("a", "x", 1), ("a", "y", 2), ("a", "z", 1), ("b", "x", 1)]
    assert index.forward.count() == 4 and {r.term: r.df for r in index.idf.collect()} == {"x": 3, "y": 2, "z": 1}
    asked = spark.createDataFrame([("one", "x"), ("two", "z y")], "q string, question string")
    got = retrieval.retrieve(index, asked, F.split("question", " "), 5).collect()
    assert sorted((r.q, r["rank"], r.doc or "-") for r in got) == [("one", 1, "b"), ("one", 2, "a"), ("one", 3, "c"), ("one", 4, "-"), ("two", 1, "a"), ("two", 2, "b"), ("two", 3, "c"), ("two", 4, "-")]
