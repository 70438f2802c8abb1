"""Batches count once, whole, however a run ends."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import appendlog
from quillspark.streaming import ingest

SCHEMA = "id long, text string"


def batch(spark, lo, hi):
    return spark.range(lo, hi).withColumn("text", F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id").cast("string"))))


def good(spark, base):
    return sorted(r.id for r in appendlog.read(spark, base, "good", SCHEMA).collect())


def sink():
    return F.when(F.col("id") % 2 == 0, "good").otherwise("bad")


def test_a_run_cut_short_between_two_sinks(spark, tmp_path, monkeypatch):
    base = f"{tmp_path}/log"
    assert good(spark, base) == []
    appendlog.append(batch(spark, 0, 10), sink(), base, "a")

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(appendlog, "commit", lost)
        with pytest.raises(KeyboardInterrupt):
            appendlog.append(batch(spark, 10, 20), sink(), base, "b")
    assert good(spark, base) == [0, 2, 4, 6, 8]
    broken = batch(spark, 10, 20).withColumn("text", F.when(F.col("id") == 19, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        appendlog.append(broken, sink(), base, "b")
    assert good(spark, base) == [0, 2, 4, 6, 8]
    for _ in range(2):
        done = appendlog.append(batch(spark, 10, 20), sink(), base, "b")
        assert done["rows"] == {"good": 5, "bad": 5}
    assert good(spark, base) == list(range(0, 20, 2))
    texts = {r.id: r.text for r in appendlog.read(spark, base, "bad", SCHEMA).collect()}
    assert texts[15] is None and texts[11] == "t11" and len(texts) == 10
    assert appendlog.leftovers(spark, base) == [] and len(appendlog.leftovers(spark, base, 0)) >= 1
    assert appendlog.clear(spark, base, 0) >= 1 and good(spark, base) == list(range(0, 20, 2)) and appendlog.clear(spark, base, 0) == 0


def test_a_batch_that_counts_is_not_computed(spark, tmp_path):
    base = f"{tmp_path}/log"
    first = appendlog.append(batch(spark, 0, 4), sink(), base, "x")
    never = spark.range(3).select("id", F.raise_error(F.lit("computed")).cast("string").alias("text"))
    assert appendlog.append(never, sink(), base, "x") == first


def test_the_first_of_two_attempts_counts(spark, tmp_path):
    base = f"{tmp_path}/log"
    one, two = (appendlog.stage(batch(spark, 0, n), sink(), base, "x") for n in (4, 8))
    assert appendlog.commit(spark, base, two) and not appendlog.commit(spark, base, one)
    assert appendlog.append(batch(spark, 0, 2), sink(), base, "x") == two and good(spark, base) == [0, 2, 4, 6]


def test_empty_batches_null_sinks_and_names(spark, tmp_path):
    base = f"{tmp_path}/log"
    assert appendlog.append(batch(spark, 0, 0), sink(), base, "empty")["rows"] == {} and good(spark, base) == []
    assert appendlog.append(batch(spark, 0, 3), F.lit(None), base, "none")["rows"] == {"none": 3}
    for name in ("", "../x", "a/b", "_a"):
        with pytest.raises(ValueError):
            appendlog.append(batch(spark, 0, 3), sink(), base, name)


def test_a_stream_repeats_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    base, check = f"{tmp_path}/log", f"{tmp_path}/check"
    for n in range(3):
        (source / f"{n}.jsonl").write_text(f'{{"n": {n}}}\n\nnot json\n')
        ingest.ingest_batches(spark, str(source), base, check, 1).awaitTermination()
    got = [r.value for r in appendlog.read(spark, base, "good", "value string, bad boolean").collect()]
    assert sorted(got) == [f'{{"n": {n}}}' for n in range(3)]
    assert appendlog.read(spark, base, "bad", "value string, bad boolean").count() == 3
    # The stream forgets that its last batch ended, as after a failure, and runs it once more.
    for last in ("2", ".2.crc"):
        (tmp_path / "check" / "commits" / last).unlink(missing_ok=True)
    ingest.ingest_batches(spark, str(source), base, check, 1).awaitTermination()
    assert appendlog.read(spark, base, "good", "value string, bad boolean").count() == 3
