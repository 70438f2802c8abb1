"""Answers, datasets and reports on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import answers as A
from quillspark.operators import audit, dataset, gate, reports


def _contexts(spark, expected):
    questions = spark.createDataFrame([(1, "what is fast"), (2, "fail please"), (3, "nothing here")], "q long, question string")
    ranked = spark.createDataFrame([(1, 1, 7, 0.5), (1, 2, 8, 0.25), (2, 1, 8, 0.123456789)], "q long, rank long, doc long, score double")
    chunks = spark.createDataFrame([(7, "c7", "p", "a1", "t", "s", "section", "x  y"), (8, "c8", "r", "a2", None, "s", "section", None)], "doc long, chunk_id string, paper_id string, arxiv_id string, title string, section_heading string, source_type string, text string")
    return A.contexts(questions, A.hits(ranked, chunks), spark.createDataFrame(expected, "q long, field string, value string"))


def test_contexts_match_any_identifier(spark):
    rows = {r.q: r for r in _contexts(spark, [(1, "arxiv_id", "a2"), (2, "paper_id", "none"), (3, "chunk_id", "")]).collect()}
    assert (rows[1].hit, rows[1].hit_rank, rows[1].reciprocal_rank) == (True, 2, 0.5)
    assert (rows[2].has_expected, rows[2].hit) == (True, False) and not rows[3].has_expected and rows[3].retrieved == []
    assert [h.citation_label for h in rows[1].retrieved] == ["[C1]", "[C2]"] and rows[1].retrieved[0].text_preview == "x y"
    assert rows[2].retrieved[0].score == 0.12345679


def test_answers_fail_alone(spark):
    from functools import partial

    asked = _contexts(spark, [(1, "chunk_id", "c7"), (2, "chunk_id", "c7")])
    rows = {r.q: r for r in A.answers(asked, partial(A.CitingModel, "fail")).collect()}
    assert (rows[1].generation_status, rows[1].citations, rows[1].answer) == ("success", ["c7"], "As c7 says.")
    assert (rows[2].generation_status, rows[2].error_categories, rows[2].note) == ("backend_error", ["backend_error"], "RuntimeError: no answer")
    assert rows[3].citations == [] and rows[3].grounding_status == "not_reviewed"
    counts = {r.label: r.records for r in A.error_counts(A.answers(asked, partial(A.CitingModel, "fail"))).collect()}
    assert len(counts) == 10 and (counts["retrieval_miss"], counts["empty_context"], counts["backend_error"]) == (1, 1, 1)
    summary = A.answer_summary(A.answers(asked)).first()
    assert (summary.questions_total, summary.hits, summary.hit_rate, summary.attempted) == (3, 1, 0.5, 0)


def test_models_by_name(spark):
    assert A.model_config("BAAI/bge-m3")[1] == 1024
    assert spark.range(1).select(A.with_prefix(F.lit("x"), "e5-small-v2", "query"), A.with_prefix(F.lit(None), "bge-m3", "passage")).first()[:] == ("query: x", "")
    with pytest.raises(ValueError):
        A.model_config("other")
    with pytest.raises(ValueError):
        A.with_prefix(F.lit("x"), "bge-m3", "title")


def test_flatten_takes_each_file_once(spark):
    files = [("p", "d/main.tex", "\\documentclass{a} A \\input{one} \\include{two.tex} \\input{gone}"), ("p", "d/one.tex", "B \\input{two}"), ("p", "d/two.tex", "C \\input{one}")]
    got = dataset.flattened(spark.createDataFrame(files, "paper_id string, path string, text string")).first()
    assert got.path == "d/main.tex" and got.text.split() == ["\\documentclass{a}", "A", "B", "C", "%", "not", "found:", "gone"]


def test_inclusions_follow_the_order_of_reading(spark):
    """Circles, files included twice, missing ones and deep chains, against a recursion that keeps what it has seen."""
    import random
    import re

    rng, files, want = random.Random(5), [], {}

    def plain(held, root):
        seen = set()

        def expand(path):
            seen.add(path)

            def one(match):
                name = root + match.group(1).strip().removeprefix("./")
                target = next((p for p in (name, name + ".tex") if p in held), None)
                if target is None:
                    return f"\n% not found: {match.group(1)}\n"
                return "\n" + ("" if target in seen else expand(target)) + "\n"

            return re.sub(r"\\(?:input|include)\{([^{}]+)\}", one, held[path] or "")

        return expand(root + "main.tex")

    for paper in range(25):
        names = [f"f{k}" for k in range(rng.randrange(1, 9))]
        held = {}
        for k, name in enumerate(["main", *names]):
            chosen = [rng.choice([*names, "main", "gone"]) for _ in range(rng.randrange(0, 4))] + ([names[k]] if k < len(names) and rng.random() < 0.7 else [])
            body = "".join(f" {name}{i} \\{rng.choice(['input', 'include'])}{{{rng.choice(['', './'])}{c}{rng.choice(['', '.tex'])}}}" for i, c in enumerate(chosen))
            held[f"d/{name}.tex"] = ("\\documentclass{a}" if name == "main" else "") + body + " end"
        held["d/f0.sty"] = None
        files += [(str(paper), path, text) for path, text in held.items()]
        want[str(paper)] = plain(held, "d/")
    got = dataset.flattened(spark.createDataFrame(files, "paper_id string, path string, text string")).collect()
    assert {r.paper_id: r.text for r in got} == want


def test_papers_get_a_status(spark):
    texts = [("a", "\\section{One} words here \\[ e=1 \\]"), ("b", "plain words alone"), ("c", None), ("d", "% nothing")]
    rows = {r.paper_id: r for r in dataset.parsed(spark.createDataFrame(texts, "paper_id string, text string"))["papers"].collect()}
    assert [rows[p].parsing_status for p in "abcd"] == ["success", "partial", "failed", "failed"]
    assert rows["b"].errors == [] and rows["b"].warnings == ["equation_extraction_weak"]
    assert rows["c"].errors == ["plain_text_empty", "chunk_generation_empty"]
    assert dataset.parsing_summary(spark.createDataFrame([("success",), (None,)], "parsing_status string"), 3).first()[:4] == (3, 1, 0, 1)


def test_second_form_of_chunks(spark):
    chunks = [(1, "c1", None, "a1", "", " Method Details / Results ", "s1", "section", "some text"), (2, "c2", " ", None, None, None, "s1", "figure", None)]
    chunks = spark.createDataFrame(chunks, "pos long, chunk_id string, paper_id string, arxiv_id string, title string, section string, section_id string, source_type string, text string")
    papers = spark.createDataFrame([("p1", "a1", "Old", 1), ("p1", "a1", "New", 2)], "paper_id string, arxiv_id string, title string, pos long")
    equations = spark.createDataFrame([("p1", "s1", "e2", 2), ("p1", "s1", "e1", 1)], "paper_id string, section_id string, equation_id string, pos long")
    one, two = dataset.chunks_v1(chunks, papers, equations).orderBy("pos").collect()
    assert (one.chunk_id, one.title, one.section_normalized, one.source_refs.equation_ids) == ("p1::chunk_v1::0001", "New", "method_details_results", ["e1", "e2"])
    assert one.quality_flags == ["missing_paper_id", "missing_title", "very_short_text"] and one.source_refs.paper_record_available
    assert (two.chunk_id, two.source_type, two.text_length_chars) == ("unknown_paper::chunk_v1::0001", "unknown", 0)
    assert two.quality_flags == ["empty_text", "missing_arxiv_id", "missing_paper_id", "missing_section", "missing_title", "unknown_source_type"]


def test_numbers_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.when(F.col("id") % 2 == 0, "cold")).alias("g"), (F.col("id") * 7 - 9000).alias("pos"))
    got = audit.numbered(rows, "g", span=500).collect()
    for group in ("hot", "cold", None):
        own = sorted((r.pos, r["__n"]) for r in got if r.g == group)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_runs(spark):
    run = lambda **new: F.struct(*[F.lit(v).alias(k) for k, v in (dict(run_id="r", created_at="2020-01-01T00:00:00Z", backend="fake", model="m", prompt_version="v", prompt_template_sha256="0" * 64, extraction_schema_version="v") | new).items()])
    got = spark.range(1).select(*[dataset.run_error(r) for r in (run(), run(model=" "), run(created_at="now"), run(prompt_template_sha256="0"))]).first()
    assert got[:] == (None, "blank: model", "not in UTC: created_at", "no digest: prompt_template_sha256")


def test_sheets_are_read_back(spark, tmp_path):
    record = F.parse_json(F.lit('{"source": {"title": "A\\nb", "arxiv_id": "1705.1"}}'))
    sheet = spark.range(1, 3).select("id", reports.review_section(F.col("id"), record, F.lit("We do.")).alias("text"))
    rows = gate.review_records(sheet.select(F.col("id").cast("string").alias("path"), "text")).collect()
    assert sorted(r.record_index for r in rows) == [1, 2] and all((r.title, r.arxiv_id, r.outcome, r.fully_checked) == ("A b", "1705.1", "unclear", False) for r in rows)
    reports.write(sheet, "text", ["id"], str(tmp_path / "out"))
    assert "## Record 1: A b" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())


def test_tables(spark):
    rows = spark.createDataFrame([("b|c", None), ("a", 2)], "x string, y long")
    assert reports.table(rows, ["x", "y"], ["x"], "T").first().report == "# T\n\n| x | y |\n| --- | --- |\n| a | 2 |\n| b\\|c | n/a |\n"
