"""Entries of files whatever their size."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.operators import gate
from quillspark.sources import arrowfiles


def test_files_of_any_size(spark, tmp_path):
    big = tmp_path / "big.bin"
    with open(big, "wb") as file:
        file.truncate((2 << 30) + (100 << 20))
    digest, left = hashlib.sha256(), big.stat().st_size
    while left:
        left -= (n := min(left, 8 << 20))
        digest.update(bytes(n))
    row = gate.file_entries(spark, [(str(big), "x")]).first()
    assert row.exists and row.size_bytes == big.stat().st_size and row.sha256 == digest.hexdigest() and row.record_count is None


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_lines_across_blocks(tmp_path, monkeypatch, block):
    monkeypatch.setattr(arrowfiles, "BLOCK", block)
    text = '{"a": 1}\n\n  \t\n{"ü": " "}\nlast'
    (tmp_path / "a.jsonl").write_text(text)
    assert arrowfiles._read(f"{tmp_path}/a.jsonl") == (len(text.encode()), hashlib.sha256(text.encode()).hexdigest(), 3, None, None)


def test_documents_large_and_small(spark, tmp_path, monkeypatch):
    for name, text in (("o", ' {"a": 1} '), ("l", "[1]"), ("bad", "{"), ("number", "1"), ("empty", "")):
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "part=1").mkdir()
    (tmp_path / "part=1" / "x").write_text("x")
    wanted = [(f"{tmp_path}/{n}.json", n) for n in ("o", "l", "bad", "number", "empty", "gone")] + [(str(tmp_path), "folder"), (f"file:{tmp_path}/o.json", "again")]
    got = {r.role: r.json_top_level_type for r in gate.file_entries(spark, wanted).where("exists").collect()}
    assert got == {"o": "object", "l": "list", "bad": None, "number": got["number"], "empty": None, "again": "object"} and got["number"] not in (None, "object", "list")
    monkeypatch.setattr(arrowfiles, "WHOLE", 2)
    assert [arrowfiles._read(f"{tmp_path}/{n}.json")[4] for n in ("o", "l", "bad")] == ["object", "list", None]


def test_stores_left_to_spark(spark, tmp_path, monkeypatch):
    (tmp_path / "a{1}.jsonl").write_text("1\n\n2\n")
    (tmp_path / "b.json").write_text("[]")
    wanted = [(f"{tmp_path}/a{{1}}.jsonl", "a"), (f"{tmp_path}/b.json", "b"), (f"{tmp_path}/c.json", "c")]
    own = sorted(map(str, gate.file_entries(spark, wanted).drop("pos").collect()))
    monkeypatch.setattr(arrowfiles, "opens", lambda path: False)
    assert sorted(map(str, gate.file_entries(spark, wanted).drop("pos").collect())) == own and "jsonl" in own[0]
    assert gate.file_entries(spark, wanted).where(F.col("exists")).count() == 2
