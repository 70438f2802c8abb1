"""Folders of papers, written and read again."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import paperfolders


def lay(root, name, paper, **files):
    folder = root / "processed" / "papers" / name
    folder.mkdir(parents=True)
    if paper is not None:
        (folder / "paper.json").write_text(json.dumps(paper))
    for kind, text in files.items():
        (folder / paperfolders.FILES[kind]).write_text(text)
    return folder


def test_fields_and_fallbacks(spark, tmp_path):
    other = tmp_path / "elsewhere.jsonl"
    other.write_text('{"n": 9}\n')
    lay(tmp_path, "a", {"parsing_status": "success", "title": "A", "chunks_count": None, "files": {"chunks": "/gone/x.jsonl"}}, chunks='{"n": 1}\n\n{"n": 2}\n', equations='[{"e": 1}]')
    lay(tmp_path, "b", {"paper_id": "B", "parsing_status": "partial", "files": {"chunks": str(other)}}, chunks='{"n": 3}\n')
    lay(tmp_path, "c", {"parsing_status": "failed"}, chunks='{"n": 4}\n')
    papers = {r.folder: r for r in paperfolders.read(spark, str(tmp_path)).collect()}
    assert set(papers) == {"a", "b", "c"} and papers["a"].paper_id == "a" and papers["b"].paper_id == "B" and papers["a"].chunks_count == 0
    got = [(r.folder, r.paper_id, r.pos, r.record) for r in paperfolders.read(spark, str(tmp_path), "chunks").orderBy("folder", "pos").collect()]
    assert got == [("a", "a", 1, '{"n": 1}'), ("a", "a", 3, '{"n": 2}'), ("b", "B", 1, '{"n": 9}')]
    assert [r.record for r in paperfolders.read(spark, str(tmp_path), "equations").collect()] == ['{"e": 1}']


def test_a_filter_opens_its_folder_alone(spark, tmp_path):
    lay(tmp_path, "good", {"parsing_status": "success"}, chunks='{"n": 1}\n')
    lay(tmp_path, "broken", {"parsing_status": "success"}, chunks='{"n": 1}\n[2]\n')
    lay(tmp_path, "empty", None)
    chunks = paperfolders.read(spark, str(tmp_path), "chunks")
    assert [r.record for r in chunks.where("folder = 'good'").collect()] == ['{"n": 1}']
    assert chunks.where("folder IN ('good', 'nobody', '../x')").count() == 1 and chunks.where("folder = 'nobody'").count() == 0
    with pytest.raises(Exception, match="chunks.jsonl:2: not a JSON object"):
        chunks.where("folder = 'broken'").collect()
    with pytest.raises(Exception, match="missing paper.json"):
        chunks.where("folder = 'empty'").collect()
    with pytest.raises(Exception, match="no folder of papers"):
        paperfolders.read(spark, f"{tmp_path}/none").collect()
    with pytest.raises(Exception, match="kind is one of"):
        paperfolders.read(spark, str(tmp_path), "other").collect()


def test_round_trip(spark, tmp_path):
    papers = spark.createDataFrame([("p1", "success", "Über"), ("p2", "failed", None)], "paper_id string, parsing_status string, title string")
    chunks = spark.createDataFrame([("p1", n, "x" * n + '" \n') for n in (10, 2, 1)], "paper_id string, pos long, text string")
    equations = spark.createDataFrame([("p1", 1, "a=b"), ("nobody", 1, "c")], "paper_id string, pos long, latex string")
    for _ in range(2):
        paperfolders.write({"papers": papers, "chunks": chunks, "equations": equations}, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "processed" / "papers" / "p1").iterdir() if not p.name.startswith(".")) == ["chunks.jsonl", "equations.json", "paper.json", "sections.json"]
    got = paperfolders.read(spark, str(tmp_path), "chunks").select(F.get_json_object("record", "$.text").alias("text"), "pos").orderBy("pos").collect()
    assert [r.text for r in got] == ["x" * n + '" \n' for n in (1, 2, 10)]
    titles = {r.folder: r.title for r in paperfolders.read(spark, str(tmp_path)).collect()}
    assert titles == {"p1": "Über", "p2": ""}
    assert paperfolders.read(spark, str(tmp_path), "equations").count() == 1 and paperfolders.read(spark, str(tmp_path), "sections").count() == 0
    with pytest.raises(Exception, match="no name of a folder"):
        paperfolders.write({"papers": papers.withColumn("paper_id", F.lit("../x"))}, str(tmp_path))
