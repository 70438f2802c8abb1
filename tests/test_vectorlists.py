"""Vector lists against all products, on vectors with and without clusters."""

import numpy as np
import pytest

from quillspark.operators import retrieval, vectorlists


def table(spark, x, name="doc"):
    return spark.createDataFrame([(n, [float(c) for c in row]) for n, row in enumerate(x)], f"{name} long, v array<double>")


def rows(df):
    return sorted((r.q, r.rank, r.doc, round(r.score, 7)) for r in df.collect())


@pytest.mark.parametrize("cosine", [False, True])
def test_clusters_are_left_out(spark, cosine):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 10
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.05
    docs = table(spark, x)
    queries = docs.where("doc % 50 = 0").withColumnRenamed("doc", "q")
    index = vectorlists.build(docs, cosine, block=64)
    best, first, later = vectorlists.two_rounds(index, queries, 5)
    assert rows(best) == rows(retrieval.vector_top_k(queries, docs, 5, cosine))
    assert vectorlists.share_visited(index, first, later).first()["share"] < 0.35


@pytest.mark.parametrize("cosine", [False, True])
def test_ragged_null_zero_and_tied_vectors(spark, cosine):
    data = [(1, [1.0, None, 2.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [3.0]), (6, [1.0, 0.0, 2.0, 9.0]), (7, [1.0, 0.0, 2.0]), (7, [1.0, 0.0, 2.0]), (8, [-1.0, -1.0, -1.0])]
    docs = spark.createDataFrame(data, "doc long, v array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (20, [0.0]), (21, None), (22, [1.0, 1.0, 1.0, 1.0, 50.0])], "q long, v array<double>")
    index = vectorlists.build(docs, cosine, lists=3, block=2)
    for k in (1, 3, 20):
        assert rows(vectorlists.search(index, queries, k)) == rows(retrieval.vector_top_k(queries, docs, k, cosine))


def test_many_copies_and_text_ids(spark):
    docs = spark.createDataFrame([(f"d{n:04d}", [1.0, 0.5] if n % 3 else [float(n), 1.0]) for n in range(2000)], "doc string, v array<double>")
    queries = docs.where("doc < 'd0010'").withColumnRenamed("doc", "q")
    index = vectorlists.build(docs, True, block=100)
    assert index.bounds.agg({"n": "max"}).first()[0] == 100
    assert rows(vectorlists.search(index, queries, 4)) == rows(retrieval.vector_top_k(queries, docs, 4, True))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc long, v array<double>")
    some = spark.createDataFrame([(1, [1.0])], "q long, v array<double>")
    assert vectorlists.search(vectorlists.build(none), some, 3).count() == 0
    assert vectorlists.search(vectorlists.build(some.withColumnRenamed("q", "doc")), none.withColumnRenamed("doc", "q"), 3).count() == 0
    with pytest.raises(ValueError):
        vectorlists.search(vectorlists.build(none), some, 0)
