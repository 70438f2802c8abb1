"""What the near-dedup stage of the pipeline writes to disk, and that its ways of joining agree."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.llm.common import frozen

from test_retrieval_size import written


def test_stage_exchanges_few_texts(spark, monkeypatch):
    """Of texts of which few are similar, less is written in all than 1.5 times the texts."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(32):x}" for _ in range(800)) for _ in range(400)]
    texts += [f"{t} more" for t in texts[:10]]
    docs = frozen(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    monkeypatch.setattr(simhash, "COMMON_TEXTS", 20)
    threshold, kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table of unknown size
    try:
        size = written(spark, lambda: kept.extend(r.doc_id for r in simhash.keep_one_of_each(docs).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(kept) == list(range(400)) and size < 1.5 * sum(map(len, texts))


@pytest.mark.parametrize(("sent", "rounds"), [(1 << 20, 16), (2, 16), (1, 1)])
def test_shared_keys(spark, monkeypatch, sent, rounds):
    monkeypatch.setattr(simhash, "SENT", sent), monkeypatch.setattr(simhash, "ROUNDS", rounds)
    rows = [(k, m) for k in range(12) for m in range(1 + k % 4)]
    got = simhash.shared_keys(spark.createDataFrame(rows, "key long, mark long")).select("key", "mark", "n").collect()
    assert sorted(map(tuple, got)) == [(k, m, 1 + k % 4) for k, m in rows if k % 4]


def test_repeated_rows_stay_once(spark):
    """Rows equal in id and text, texts under several ids, texts without id: by either way of taking rows."""
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "p q r s t u v"), (3, "x y z x y w q"), (4, "x y z x y w q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one_of_each(docs).collect()) == [(0, rows[3][1]), (1, rows[0][1]), (3, rows[4][1])]
    assert sorted((r.doc_id or 0) for r in simhash.keep_one_of_each(docs.where("doc_id IS NULL OR doc_id > 1")).collect()) == [0, 2, 3]
