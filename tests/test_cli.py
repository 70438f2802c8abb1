"""Sub-commands from end to end on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.cli import main
from quillspark.operators import dataset, records
from quillspark.sources import appendlog, paperfolders, readers


def _lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_pilot(spark, tmp_path, capsys):
    paper = {"arxiv_id": "1", "title": "Fast showers", "authors": ["A"], "abstract": "We do.", "categories": ["x"], "published": "", "url": "u"}
    source = tmp_path / "m.json"
    source.write_text(json.dumps([paper | {"published": "2020"}, paper | {"arxiv_id": "2", "title": ""}]))
    out = str(tmp_path / "out")
    assert main(["extract", "--input", str(source), "--out", out]) == 0
    assert main(["summary", "--input", out, "--strict"]) == 0 and "total: 1" in capsys.readouterr().out
    assert spark.read.json(f"{out}.rejected").count() == 1
    for _ in range(2):
        assert main(["extract", "--input", str(source), "--out", str(tmp_path / "log"), "--batch", "day-1"]) == 0 and '"rows": {"good": 1, "rejected": 1}' in capsys.readouterr().out
    assert appendlog.read(spark, str(tmp_path / "log"), "good", "extraction struct<title:string>").count() == 1
    assert main(["preview", "--input", out]) == 0 and "Fast showers" in capsys.readouterr().out
    assert main(["checklist", "--input", out, "--out", str(tmp_path / "sheets")]) == 0
    assert main(["review", "--input", str(tmp_path / "sheets"), "--strict"]) == 1 and "REVIEW_INCOMPLETE" in capsys.readouterr().out
    assert main(["manifest", "--out", str(tmp_path / "manifest"), f"metadata={source}"]) == 0
    assert main(["gate", "--input", str(tmp_path / "manifest"), "--strict"]) == 1 and "decision: REVISE" in capsys.readouterr().out
    assert main(["gate", "--input", str(tmp_path / "manifest"), "--strict", "--allow-unreviewed"]) == 0


def test_retrieval(spark, tmp_path, capsys):
    part = lambda n, text: {"pos": n, "chunk_id": f"c{n}", "paper_id": f"p{n}", "arxiv_id": f"a{n}", "title": f"t{n}", "section_heading": "s", "source_type": "section", "text": text}
    chunks = _lines(tmp_path / "chunks.jsonl", [part(1, "calorimeter shower simulation"), part(2, "higgs boson search"), part(3, "limits of validation")])
    ask = lambda n, text, own: {"question_id": f"q{n}", "question": text, "question_type": "other", "expected_source_arxiv_ids": own, "expected_section_keywords": []}
    questions = _lines(tmp_path / "questions.jsonl", [ask(1, "calorimeter shower", ["a1"]), ask(2, "higgs", ["a2"]), ask(3, "higgs search", ["a9"])])
    common = ["--chunks", chunks, "--questions", questions, "--out", str(tmp_path / "r")]
    assert main(["retrieve", *common, "--top-k", "1", "2", "--baseline", "0.5"]) == 0
    assert "k: 1" in (said := capsys.readouterr().out) and "delta: 0.166667" in said
    assert {(r.k, r.q) for r in spark.read.json(f"{tmp_path}/r/misses").collect()} == {(1, "q3"), (2, "q3")}
    assert main(["ask", *common, "--top-k", "1"]) == 0 and "succeeded: 3" in capsys.readouterr().out
    assert main(["ask", *common, "--retrieval-only"]) == 0 and "attempted: 0" in capsys.readouterr().out
    assert main(["embed", *common, "--top-k", "1", "--models", "bge-m3", "e5-small-v2"]) == 0 and "hit_rate: 0.666667" in capsys.readouterr().out


def test_sources(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "1705.0001v1.gz").write_bytes(b"\\documentclass{a}\\begin{document}\\section{One} some words \\[ x \\]\\end{document}")
    assert main(["parse", "--input", str(tmp_path / "src"), "--out", str(tmp_path / "o")]) == 0 and "success: 1" in capsys.readouterr().out
    (tmp_path / "src" / "1705.0002v1.gz").write_bytes(b"%PDF-1.4")
    (tmp_path / "src" / "1705.0003v1.gz").write_bytes(b"\x1f\x8b\x08\x00broken")
    record = {"arxiv_id": "1705.0001v1", "title": "T", "authors": ["A"], "abstract": "We do.", "categories": ["x"], "published": "2020", "url": "u"}
    (tmp_path / "known.json").write_text(json.dumps([record, {**record, "arxiv_id": "1705.0003v1"}]))
    assert main(["parse", "--input", str(tmp_path / "src"), "--metadata", str(tmp_path / "known.json"), "--out", str(tmp_path / "o2"), "--folders", str(tmp_path / "each")]) == 0 and "failed: 2" in capsys.readouterr().out
    each = {r.folder: r.parsing_status for r in paperfolders.read(spark, str(tmp_path / "each")).collect()}
    want = {r.paper_id: r.parsing_status for r in spark.read.parquet(str(tmp_path / "o2" / "papers")).collect()}
    assert each == want and len(each) > 2
    kept = {r.paper_id: r for r in spark.read.parquet(f"{tmp_path}/o2/papers").collect()}
    assert [(kept[k].parsing_status, kept[k].errors) for k in sorted(kept)] == [("success", []), ("failed", ["metadata_error"]), ("failed", ["archive_extract_error"])]
    assert kept["1705_0001v1"].title == "T" and set(kept["1705_0001v1"].files) == {"sections", "equations", "chunks"} and not kept["1705_0003v1"].files
    assert readers.query_address(identifier="arXiv:1705.0001v1").endswith("max_results=1&id_list=1705.0001v1")
    assert main(["address", "--query", "higgs", "--most", "2"]) == 0 and "search_query=higgs&sortBy=submittedDate" in capsys.readouterr().out


def test_whole_pilot(spark, tmp_path, capsys):
    paper = {"arxiv_id": "1", "title": "Fast showers", "authors": ["A"], "abstract": "We do.", "categories": ["x"], "published": "2020", "url": "u"}
    source = tmp_path / "m.json"
    source.write_text(json.dumps([paper]))
    with pytest.raises(ValueError):
        main(["pilot", "--input", str(source), "--out", str(tmp_path / "p")])
    assert main(["pilot", "--input", str(source), "--out", str(tmp_path / "p"), "--small", "--strict"]) == 1
    said = capsys.readouterr().out
    assert "decision: REVISE" in said and "reviews: 1" in said and "next: REVISE_BEFORE_SCALING" in said


def test_abstracts(spark):
    from quillspark.operators import records

    rows = spark.createDataFrame([("1", "own"), ("1", " "), ("2", None), (None, None)], "arxiv_id string, abstract string")
    known = spark.createDataFrame([(1, "1", "old"), (2, "1", "new"), (3, "1", "")], "pos long, arxiv_id string, abstract string")
    assert sorted(r.abstract for r in records.with_abstract(rows, known).collect()) == ["", "", "new", "own"]


def test_benchmark_and_analysis(spark, tmp_path, capsys):
    paper = lambda n: {"arxiv_id": str(n), "title": f"T{n}", "authors": ["A"], "abstract": "We do.", "categories": ["x"], "published": "2020", "url": "u"}
    for name, rows in (("a", [paper(1), paper(2)]), ("b", [paper(3)]), ("c", [paper(4) | {"title": " "}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    path = lambda n: str(tmp_path / n)
    assert main(["benchmark", "--first", path("a.json"), "--second", path("b.json"), "--out", path("o"), "--strict"]) == 0 and "formal_status: PASS" in capsys.readouterr().out
    assert main(["benchmark", "--first", path("a.json"), "--second", path("b.json"), "--out", path("w"), "--workflow", "--strict"]) == 1 and "decision: REVISE" in capsys.readouterr().out
    held = spark.read.option("multiLine", True).json(path("o/query_a_summary")).first()
    assert held.total_records == 2 and held.evaluation_status == "PASS" and held.backend_counts.fake == 2
    doc = {"name": "x", "status": "PASS", "missing_paths": [], "files": [{"path": "p", "role": "jsonl_extractions", "exists": True, "record_count": 2}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    said = ["analyse", "--manifest", path("m.json"), "--out", path("an"), "--summaries", path("o/query_a_summary")]
    assert main(said) == 0 and "recommendation: RUN_QUALITY_GATE" in capsys.readouterr().out
    assert main([*said, "--decision", "ACCEPT", "--strict"]) == 0 and "formal_records: 2" in capsys.readouterr().out
    assert spark.read.option("multiLine", True).json(path("an")).first().role_counts.jsonl_extractions == 1


def test_dataset(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "1705.0001v1.gz").write_bytes(b"\\documentclass{a}\\begin{document}\\section{One} some words \\[ x \\]\\end{document}")
    (tmp_path / "m.json").write_text(json.dumps([{"arxiv_id": "1705.0001v1", "title": "T", "authors": ["A"], "abstract": "We do.", "categories": ["x"], "published": "2020", "url": "u"}]))
    assert main(["parse", "--input", str(tmp_path / "src"), "--out", str(tmp_path / "o")]) == 0
    assert main(["dataset", "--input", str(tmp_path / "o"), "--metadata", str(tmp_path / "m.json"), "--domain", "d", "--out", str(tmp_path / "d"), "--strict"]) == 0
    assert "status: PASS" in capsys.readouterr().out
    held = spark.read.option("multiLine", True).json(str(tmp_path / "d/manifest")).first()
    assert held.counts.asDict() == {"chunks": 1, "papers": 1, "equations": 1, "eval_questions": 8}
    assert spark.read.json(str(tmp_path / "d/chunks")).first().metadata.domain == "d"
    with pytest.raises(ValueError):
        main(["dataset", "--input", "x", "--metadata", "x", "--domain", " ", "--out", "x"])


def test_smoke(spark, tmp_path, capsys):
    assert main(["smoke", "--out", str(tmp_path)]) == 0 and "smoke: done" in capsys.readouterr().out


def test_shape_of_smoke_records(spark):
    run = {"run_id": "r", "created_at": "2020Z", "backend": "fake", "model": "fake", "prompt_version": "v1", "prompt_template_sha256": "a" * 64, "extraction_schema_version": "v1"}
    good = {"source": dict.fromkeys(["arxiv_id", "title", "authors", "categories", "published", "url"], "x"), "extraction": dict.fromkeys(records.EXTRACTION, "x"), "run": run}
    bad = [{**good, "run": {**run, "backend": "other"}}, {**good, "run": {**run, "run_id": " "}}, {**good, "source": []}, {"extraction": {}}, {**good, "extraction": {"title": "x"}}]
    rows = spark.createDataFrame([(n, json.dumps(r)) for n, r in enumerate([good, *bad])], "n int, t string")
    got = [r.e for r in rows.orderBy("n").select(dataset.smoke_error(F.parse_json("t")).alias("e")).collect()]
    assert got == [None, "not offline: backend", "blank: run_id", "no object: source", "no object: source", "missing: extraction.field"]


def test_second_form(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    part = lambda n, text: {"pos": n, "chunk_id": f"c{n}", "paper_id": "p1", "arxiv_id": "a1", "title": "t", "section_id": "s1" if n < 3 else "s2", "section_heading": "Methods", "source_type": "section", "text": text}
    _lines(tmp_path / "in/chunks", [part(1, "calorimeter shower simulation " * 9), part(2, "higgs boson"), part(3, "limits of validation " * 9)])
    _lines(tmp_path / "in/papers", [{"pos": 1, "paper_id": "p1", "arxiv_id": "a1", "title": "T"}])
    equations = _lines(tmp_path / "equations.jsonl", [{"pos": 1, "paper_id": "p1", "section_id": "s1", "equation_id": "e1"}])
    assert main(["second", "--input", str(tmp_path / "in"), "--out", str(tmp_path / "o"), "--equations", equations, "--question", "higgs"]) == 0
    assert "with_equations: 2" in capsys.readouterr().out
    held = json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/o/manifest").collect()))
    assert held["counts"] == {"chunks": 3, "papers": 1, "with_equations": 2, "flagged": 1} and held["smoke"]["chunk_id"] == "p1::chunk_v1::0002"
    audit = {(r.dimension, r.value): r.chunks for r in spark.read.json(f"{tmp_path}/o/audit").collect()}
    assert audit[("flag", "very_short_text")] == 1 and audit[("section", "Methods")] == 3 and audit[("paper", "p1")] == 3
    assert spark.read.parquet(f"{tmp_path}/o/chunk_ids").count() == 3
