"""Small fixtures with results worked out by hand."""

import io
import json
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import audit, chunking, evaluate, gate, manifest, markup, pilot, questions, records, reports, retrieval
from quillspark.sources import readers, sinks
from quillspark.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_words_are_unicode(spark):
    assert one(spark, T.word_count(F.col("x")), x="über l'été déjà-vu 3") == 4
    assert one(spark, T.tokens_v0(F.col("x")), x="Über X_1") == ["ber", "x_1"]
    assert one(spark, T.tokens_v1(F.col("x")), x="The fast-sim_ model+ 3.14 x") == ["fast-sim", "model", "3.14"]


def test_ids(spark):
    assert one(spark, T.normalize_section(F.col("x")), x=" Method Details / Results ") == "method_details_results"
    assert one(spark, T.normalize_section(F.col("x")), x=" !! ") == "unknown"
    assert one(spark, T.paper_key(F.col("x")), x=" arXiv:https://arxiv.org/pdf/1705.00001v1.pdf ") == "1705.00001v1"
    assert one(spark, T.chunk_id_v1(F.col("x"), F.lit(7)), x="1705_00001v1") == "1705_00001v1::chunk_v1::0007"


def naive_windows(words, target, overlap, tail):
    out, start = [], 0
    while start < len(words):
        end = start + target
        if end >= len(words) or len(words) - end < tail:
            out.append(words[start:] if end < len(words) else words[start:end])
            break
        out.append(words[start:end])
        start += target - overlap
    return out


def test_windows(spark):
    text = " ".join(f"w{i}" for i in range(260))
    got = chunking.windows(spark.createDataFrame([("p", 0, text)], "paper_id string, pos int, text string"), 120, 30, 40).orderBy("chunk_no").collect()
    assert [r.word_count for r in got][:1] == [120] and len(got) == 3
    assert chunking.windows(spark.createDataFrame([("p", 0, " ")], "paper_id string, pos int, text string")).count() == 0


def fixture(spark):
    docs = spark.createDataFrame([("calo", "calorimeter shower simulation fast"), ("higgs", "higgs boson mass"), ("limit", "limits and uncertainty")], "doc string, text string")
    questions = spark.createDataFrame([("q1", "calorimeter simulation"), ("q2", "uncertainty"), ("q_miss", "dark matter")], "q string, question string")
    return docs, questions


def test_retrieval_and_evaluation(spark):
    docs, questions = fixture(spark)
    index = retrieval.build_index(docs, T.tokens_v0(F.col("text")))
    hits = retrieval.retrieve(index, questions, T.tokens_v0(F.col("question")), 3)
    rows = {(r.q, r["rank"]): (r.doc, r.score) for r in hits.collect()}
    assert len(rows) == 9 and rows["q1", 1][0] == "calo" and rows["q1", 1][1] > rows["q1", 2][1] == 0
    assert [rows["q_miss", k][0] for k in (1, 2, 3)] == ["calo", "higgs", "limit"]
    expected = spark.createDataFrame([("q1", "calo"), ("q2", "limit"), ("q_miss", "gone")], "q string, doc string")
    graded = evaluate.at_each_k(evaluate.per_question(questions, hits, expected), [3, 1, 2, 2])
    got = {r.k: (r.questions, r.hits, r.hit_rate) for r in graded.groupBy("k").agg(*evaluate.hit_metrics()).collect()}
    assert got == {k: (3, 2, 0.666667) for k in (1, 2, 3)}


def test_vectors(spark):
    x = spark.createDataFrame([([3.0, 4.0], [1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    assert x.select(V.dot(F.col("a"), F.col("b"))).first()[0] == 3.0
    assert x.select(V.normalize(F.col("a"))).first()[0] == [0.6, 0.8]
    assert x.select(V.cosine(F.col("a"), F.col("z"))).first()[0] == 0.0
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 30)], "doc long, v array<double>")
    top = retrieval.vector_top_k(rows.where("doc = 3").withColumnRenamed("doc", "q"), rows, 2).collect()
    assert sorted((r["rank"], r.doc) for r in top) == [(1, 29), (2, 28)]


def test_containing(spark):
    docs = [(1, "a rose is a rose"), (2, "rosé, 漢字"), (3, None), (4, ""), (5, "is a"), (5, "is a")]
    asked = [(10, "rose"), (11, "is a"), (12, "漢"), (13, ""), (14, None), (15, "rose"), (16, "e is"), (17, "Rose")]
    want = sorted((q, d) for q, w in asked for d, t in docs if w is not None and t is not None and w in t)
    rows, passages = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(asked, "q long, question string")
    for block in (1 << 20, 4):
        assert sorted((r.q, r.doc) for r in retrieval.containing(rows, passages, block).collect()) == want
    assert retrieval.containing(rows, passages.where("q < 0")).count() == 0
    assert retrieval.containing(rows.where("doc < 0"), passages).count() == 0


def test_citations(spark):
    rows = spark.createDataFrame([(["c1"], ["c1"], ["c1", "c2"]), ([], ["c1"], ["c1"]), (["c2"], ["c1"], ["c1", "c2"]), (["c9"], ["c1"], ["c1"]), ([None], ["c1"], ["c1"])], "cited array<string>, got array<string>, known array<string>")
    assert [r[0] for r in rows.select(evaluate.citation_status(F.col("cited"), F.col("got"), F.col("known"))).collect()] == ["valid", "missing_citations", "cites_unretrieved_chunk", "unknown_citation", "unknown_citation"]
    got = spark.createDataFrame([("see p::c_1 and p::c_12", ["p::c_1", "p::c_2"])], "answer string, ids array<string>")
    assert got.select(evaluate.mentioned(F.col("answer"), F.col("ids"))).first()[0] == ["p::c_1"]


def test_latex(spark):
    text = "\\documentclass{a}\\begin{document} lost \\section{One} A % no\nB \\[ e=1 \\]\n\\subsection{Two} C \\begin{equation}f\\end{equation} D\\end{document}"
    src = spark.createDataFrame([("p", text)], "paper_id string, text string").withColumn("text", markup.strip_comments(F.col("text")))
    found = markup.equations(src).orderBy("equation_no").collect()
    assert [e.raw_latex for e in found] == ["\\[ e=1 \\]", "\\begin{equation}f\\end{equation}"] and found[1].context_after == "D"
    parts = markup.sections(src.withColumn("text", markup.with_placeholders(F.col("text"))))
    rows = parts.orderBy("section_no").collect()
    assert [(r.level, r.text) for r in rows] == [(1, "A B [EQUATION_001]"), (2, "C [EQUATION_002] D")]
    linked = markup.equation_sections(markup.equations(src), parts).orderBy("equation_no").collect()
    assert linked[1].section_id == rows[-1].section_id


def test_audit_flags(spark):
    schema = "pos long, paper_id string, arxiv_id string, title string, section string, source_type string, text string"
    chunks = spark.createDataFrame([(0, "", "", "", "", "odd", " "), (1, "p", "a", "t", "s", "section", "x" * 90), (2, "q", "a", "t", "s", "section", "Same  text"), (3, "p", "a", "t", "s", "section", "same text")], schema)
    papers = spark.createDataFrame([("p",)], "paper_id string")
    got = {r.pos: r.quality_flags for r in audit.with_flags(chunks, papers).collect()}
    assert got[0] == ["empty_text", "missing_paper_id", "missing_arxiv_id", "missing_title", "missing_section", "unknown_source_type"]
    assert got[1] == [] and got[2] == ["very_short_text", "orphan_chunk", "duplicate_text_candidate"]


def test_last_paper_wins_and_equations(spark):
    papers = spark.createDataFrame([("p", "a", "old", 0), ("p", "a", "new", 1)], "paper_id string, arxiv_id string, title string, pos long")
    chunks = spark.createDataFrame([("p", "a", "s1", 0), ("?", "a", "s1", 1)], "paper_id string, arxiv_id string, section_id string, pos long")
    eqs = spark.createDataFrame([("p", "s1", 2, "eq_002"), ("p", "s1", 1, "eq_001")], "paper_id string, section_id string, pos long, equation_id string")
    got = audit.attach_equations(audit.resolve_papers(chunks, papers), eqs).orderBy("pos").collect()
    assert [(r.paper_title, r.resolved_paper_id, r.equation_ids) for r in got] == [("new", "p", ["eq_001", "eq_002"])] * 2


def test_contracts(spark):
    good = {"arxiv_id": "1", "title": "t", "authors": ["a"], "abstract": "x", "categories": [], "published": "", "url": "u"}
    cases = [good, {**good, "title": " "}, {k: v for k, v in good.items() if k != "url"}, {**good, "authors": "a"}, {**good, "abstract": 3}]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, j string").withColumn("r", F.parse_json("j"))
    assert [r[0] for r in rows.orderBy("i").select(records.metadata_error(F.col("r"))).collect()] == [None, "blank: title", "missing: url", "not a list of strings: authors", "not a string: abstract"]
    fake = spark.range(1).select(records.fake_extraction(F.lit("T")).alias("j")).select(F.concat(F.lit("```json\n"), "j", F.lit("\n``` tail")).alias("t"), "j")
    got = fake.select(records.extraction_error(records.parse_model_json(F.col("t")), F.json_object_keys("j"))).first()[0]
    assert got is None


def test_first_json_object(spark):
    """As a scanner of braces and strings, and a parser that keeps the last of equal keys, find it."""

    def plain(text):
        text, depth, inside, escaped = text[text.find("{") :] if "{" in text else "", 0, False, False
        for k, sign in enumerate(text):
            if inside:
                inside, escaped = (escaped or sign != '"'), (not escaped and sign == "\\")
            elif sign == '"':
                inside, escaped = True, False
            elif sign in "{}":
                depth += 1 if sign == "{" else -1
                if depth == 0:
                    try:
                        return json.loads(text[: k + 1])
                    except ValueError:
                        return None
        return None

    said = ['{"a": 1, "a": 2}', 'x {"a": {"b": 1, "b": {"c": 1, "c": [{"d": 0, "d": 9}]}}} {"z": 1}', '{"a": "}{", "b": "\\"}"} tail }', '{"a": "\\\\"} "', '{"a": 1', '{"a": "open } ', '{"a": "\\', "none", "", None, "{}", "{x}", '} {"a": null, "a": [1, 2]}', '{"a": "' + "\\n" * 20_000 + '"}']
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    got = rows.select("i", F.to_json(T.first_json(F.col("t"))).alias("j")).orderBy("i").collect()
    assert [None if r.j is None else json.loads(r.j) for r in got] == [plain(t or "") for t in said]


def test_model_errors_stay_with_their_row(spark):
    class Odd:
        def generate(self, prompt, temperature=0.0):
            if prompt == "bad":
                raise ValueError("no")
            return prompt.upper()

    rows = spark.createDataFrame([("good",), ("bad",)], "p string").select(records.generator(Odd)(F.col("p")).alias("r")).select("r.*").collect()
    assert sorted((r.text or "", r.error or "") for r in rows) == [("", "ValueError: no"), ("GOOD", "")]


def test_gate(spark):
    lit = F.lit
    row = spark.range(1).select(
        gate.summary_verdict(lit("PASS"), lit(2), lit(1), lit(2)), gate.summary_verdict(lit("REVIEW_INCOMPLETE"), lit(2), lit(0), lit(2)), gate.summary_verdict(lit("x"), lit(2), lit(1), lit(2)),
        gate.manifest_verdict(lit("WARN"), lit(0), lit(1)), gate.manifest_verdict(lit("PASS"), lit(1), lit(1)), gate.recommendation(lit("PASS"), lit(0), lit("ACCEPT")),
    ).first()
    assert tuple(row) == ("ACCEPT", "REVISE", "REJECT", "REVISE", "REJECT", "READY_FOR_NEXT_PILOT_CYCLE")
    none = spark.createDataFrame([], "verdict string")
    assert gate.gate("ACCEPT", none).first().decision == "REVISE" and gate.gate("ACCEPT", none, False).first().decision == "ACCEPT"


def test_reviews(spark):
    lines = ["- [x] `main_claim` ok", "- [X] `method` ok", "- [x] `limitations` ok", "- [x] No unsupported scientific claim", "- [x] The confidence label fits"]
    sheet = lambda n, notes, outcome: f"## Record {n}: Title {n}\n- arXiv ID: `17.{n}`\n" + "\n".join(lines if n < 4 else lines[:4]) + f"\n{notes}\n\nReview outcome: {outcome}\n"
    text = "# R\n" + sheet(1, "- [x] Notes: fine", "`pass`") + sheet(2, "- [ ] Notes: no", "`pass | revise | reject | unclear`") + sheet(3, "- [ ] Notes: -", "maybe") + sheet(4, "- [ ] Notes: x", "Reject")
    rows = gate.review_records(spark.createDataFrame([("f", text), ("none", "nothing")], "path string, text string"))
    got = rows.orderBy("record_index").collect()
    assert [(r.title, r.arxiv_id, r.notes, r.outcome, r.fully_checked) for r in got] == [("Title 1", "17.1", "fine", "pass", True), ("Title 2", "17.2", "no", "unclear", True), ("Title 3", "17.3", "-", "unclear", True), ("Title 4", "17.4", "x", "reject", False)]
    total = gate.review_summary(rows, gate.CHECKS).first()
    assert (total.status, total.total_records, total.fully_checked, total.confidence_plausible, total.method_supported) == ("REVIEW_REJECTED_RECORDS", 4, 3, 3, 4)
    assert gate.review_summary(rows.where("outcome = 'pass'")).first().status == "PASS" and gate.review_summary(rows.limit(0)).first().status == "REVIEW_INCOMPLETE"


def test_main_file(spark):
    files = [("p", "a/paper.tex", "\\documentclass{a} \\begin{document} x"), ("p", "a/big.sty", "\\documentclass \\begin{document}" + "x" * 90_000), ("p", "a/long.tex", "x" * 70_000), ("q", "ms.tex", "é" * 10), ("q", "other.tex", "x" * 25_021)]
    got = {r.paper_id: r.path for r in markup.main_file(spark.createDataFrame(files, "paper_id string, path string, text string")).collect()}
    assert got == {"p": "a/paper.tex", "q": "other.tex"}


def test_validation_names_what_is_missing(spark):
    whole = {f: "x" for f in audit.REQUIRED_METADATA}
    rows = [("c1", "p1", "a", "s", "i", "h", "one two", 2, whole), ("c1", "p9", " ", "figure", "i", "h", "", None, {**whole, "domain": ""}), ("c3", "p1", "a", "s", "i", "h", "t", 1, None)]
    names = ["chunk_id", "paper_id", "arxiv_id", "source_type", "section_id", "section_heading", "text", "word_count", "metadata"]
    chunks = spark.createDataFrame(rows, "chunk_id string, paper_id string, arxiv_id string, source_type string, section_id string, section_heading string, text string, word_count long, metadata map<string,string>")
    papers = spark.createDataFrame([("p1",), ("p2",), ("",)], "paper_id string")
    got = {r.field: r.chunks for r in audit.missing_counts(chunks).collect()}
    assert names == chunks.columns and got == {"title": 3, "arxiv_id": 1, "text": 1, "word_count": 2, "metadata": 1, "metadata.domain": 1}
    row = audit.validate_chunks(chunks, papers).first()
    assert (row.status, row.missing_fields, row.duplicate_ids, row.papers_without_chunks, row.orphan_chunks) == ("FAIL", 9, 1, 1, 1)
    fine = spark.createDataFrame([("c1", "p1", "a", "t", "section", "i", "h", "one two", 2, whole)], "chunk_id string, paper_id string, arxiv_id string, title string, source_type string, section_id string, section_heading string, text string, word_count long, metadata map<string,string>")
    assert audit.validate_chunks(fine, papers.where("paper_id = 'p1'")).first().status == "PASS" and audit.validate_chunks(fine, papers).first().status == "REVISE"
    assert "| missing_field_counts | title | 3 |" in reports.quality_report(audit.validate_chunks(chunks, papers), audit.quality_counts(audit.with_columns(chunks), papers.withColumn("parsing_status", F.lit("success"))), "Chunks").first().report


def test_models_are_asked_once(spark, tmp_path):
    class Counting:
        """A model whose every answer is another one."""

        def generate(self, prompt, temperature=0.0):
            import uuid

            return uuid.uuid4().hex

    rows = spark.range(40).select("id", F.concat(F.lit("q"), F.col("id").cast("string")).alias("prompt"))
    said = rows.withColumn("a", records.generator(Counting)(F.col("prompt"))).select("id", "a.text")
    sinks.append_valid(said, F.col("text") < "8", f"{tmp_path}/good", f"{tmp_path}/bad")
    good, bad = (spark.read.schema("id long, text string").json(f"{tmp_path}/{n}").collect() for n in ("good", "bad"))
    assert len(good) + len(bad) == 40 and all(r.text < "8" for r in good) and all(r.text >= "8" for r in bad) and good and bad


def test_vectors_of_unequal_length(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, [0.5, None, 1.0, 9.0]), (4, []), (5, None)], "doc long, v array<double>")
    queries = spark.createDataFrame([(10, [1.0, 1.0]), (11, [1.0, 1.0, 1.0, 1.0])], "q long, v array<double>")
    got = {(r.q, r.doc): r.score for r in retrieval.vector_top_k(queries, vectors, 5).collect()}
    assert got == {(10, 1): 3.0, (10, 2): 1.0, (10, 3): 0.5, (11, 1): 6.0, (11, 2): 1.0, (11, 3): 10.5}
    named = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "doc string, v array<double>")
    assert [(r.q, r.doc) for r in retrieval.vector_top_k(named.withColumnRenamed("doc", "q"), named, 1, cosine=True).orderBy("q").collect()] == [("a", "b"), ("b", "a")]


def plain_top(docs, questions, k):
    """TF-IDF cosine of all pairs: (q, rank, doc, score), ties by id."""
    from collections import Counter
    from math import log, sqrt

    df = Counter(t for _, text in docs for t in set(text.split()))
    idf = {t: log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}
    weigh = lambda text: {t: n * idf[t] for t, n in Counter(text.split()).items() if t in idf}
    held, out = [(d, weigh(text)) for d, text in docs], []
    for q, text in questions:
        own = weigh(text)
        size = sqrt(sum(w * w for w in own.values()))
        scores = []
        for d, w in held:
            norm = sqrt(sum(x * x for x in w.values()))
            scores.append((-round(sum(x * own.get(t, 0) for t, x in w.items()) / (size * norm), 9) + 0.0 if size and norm else 0.0, d))
        out += [(q, rank, d, -score + 0.0) for rank, (score, d) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize(("first", "gap", "whole"), [(4096, 0.3, 0.6), (10, 1.0, 2.0), (30, 0.2, 2.0), (10, 0.5, 0.0)])
def test_impact_index(spark, monkeypatch, first, gap, whole):
    import random

    rng = random.Random(4)
    word = lambda: f"w{int(60 ** rng.random() * 3)}"
    docs = [(n, " ".join(word() for _ in range(rng.randrange(1, 60)))) for n in range(500)] + [(500, ""), (501, "w3 w3"), (502, "w3 w3")]
    questions = [(n, " ".join(word() for _ in range(1 + n % 12))) for n in range(30)] + [(98, ""), (99, "unknown words only"), (100, "rare")]
    docs.append((503, "rare w3 w4"))
    monkeypatch.setattr(retrieval, "BLOCK", 8), monkeypatch.setattr(retrieval, "GAP", gap), monkeypatch.setattr(retrieval, "WHOLE", whole)
    monkeypatch.setattr(retrieval, "FIRST_POSTINGS", first)
    index = retrieval.build_index(spark.createDataFrame(docs, "doc long, text string"), F.split("text", " "))
    got = retrieval.retrieve(index, spark.createDataFrame(questions, "q long, text string"), F.split("text", " "), 4).collect()
    rows = sorted((r.q, r["rank"], r.doc, r.score) for r in got if r.q != 98)  # splitting an empty text gives one empty token
    want = sorted(plain_top(docs, [x for x in questions if x[0] != 98], 4))
    assert [r[:3] for r in rows] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-8 for a, b in zip(rows, want, strict=True))


def test_impact_index_reads_what_can_matter(spark, monkeypatch):
    """A rare word decides the first place: the postings of a word that all documents have are skipped, and only the asked buckets read."""
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    docs = [(n, "common " + " ".join(f"x{n}_{k}" for k in range(30))) for n in range(400)] + [(900 + n, f"common rare{n}") for n in range(20)]
    index = retrieval.build_index(spark.createDataFrame(docs, "doc long, text string"), F.split("text", " "))
    asked = retrieval.frozen(retrieval.asked_terms(index, spark.createDataFrame([(1, "common rare7")], "q long, text string"), F.split("text", " ")))
    plan = retrieval.to_read(index, asked, 1, first=40).groupBy("read").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks")).collect()
    count = {r.read: r.n for r in plan}
    assert count == {True: 1, False: 420}
    text = retrieval._partial(index, retrieval.frozen(retrieval.to_read(index, asked, 1).where("read")))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\n]{0,20}bucket", text) and index.buckets == 16
    empty = retrieval.build_index(spark.createDataFrame([], "doc long, text string"), F.split("text", " "))
    assert retrieval.retrieve(empty, spark.createDataFrame([(1, "a")], "q long, text string"), F.split("text", " "), 3).count() == 0



def test_readers_hold_to_their_contracts(spark, tmp_path):
    paper = {"arxiv_id": "1", "title": "T", "authors": ["A"], "abstract": "We do.", "categories": ["x"], "published": "2020", "url": "u", "note": "more"}
    write = lambda name, value: (tmp_path / name).write_text(json.dumps(value)) and f"{tmp_path}/{name}"
    good = readers.metadata_records(spark, write("good.json", [paper, paper | {"arxiv_id": "2"}])).orderBy("index").collect()
    assert [(r["index"], r.arxiv_id, r.authors) for r in good] == [(1, "1", ["A"]), (2, "2", ["A"])]
    assert readers.metadata_records(spark, write("one.json", paper), single=True).first().arxiv_id == "1"
    bad = [("second.json", [paper, paper | {"title": " "}], False, "record 2: blank: title"), ("empty.json", [], False, "no record"), ("object.json", paper, False, "no JSON array"), ("list.json", [paper], True, "no JSON object"), ("text.json", [1], False, "record 1: no object")]
    for name, value, single, message in bad:
        with pytest.raises(Exception, match=message):
            readers.metadata_records(spark, write(name, value), single).collect()
    (tmp_path / "none.txt").write_text("# nothing\n\n")
    with pytest.raises(ValueError):
        readers.id_list(spark, f"{tmp_path}/none.txt")
    with pytest.raises(FileNotFoundError, match="a.jsonl.*b.jsonl"):
        readers.dataset_tables(spark, {"chunks": f"{tmp_path}/a.jsonl", "papers": f"{tmp_path}/good.json", "more": f"{tmp_path}/b.jsonl"})
    with pytest.raises(Exception, match="without entries"):
        readers.atom(spark.createDataFrame([("<feed></feed>",)], "xml string")).collect()


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "long.jsonl").write_text("".join(json.dumps({"n": n, "pad": "x" * (n % 50)}) + "\n" for n in range(5000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = readers.jsonl(spark, f"{tmp_path}/long.jsonl")
        assert rows.rdd.getNumPartitions() > 1
        got = rows.select("line", F.variant_get("record", "$.n", "long").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted((r.line, r.n) for r in got) == [(n + 1, n) for n in range(5000)]


def test_manifests(spark, tmp_path):
    for name, text in (("metadata_a.json", "[]"), ("x.jsonl", '{"a": 1}\n\n{"a": 2}\n'), ("x_summary.json", "{}"), ("x_manual_review_summary.json", "{}"), ("other.txt", "x"), ("pilot_report.json", "{")):
        (tmp_path / name).write_text(text)
    found = manifest.discover(spark, str(tmp_path))
    assert [(p.rsplit("/")[-1], r) for p, r in found] == [("metadata_a.json", "metadata"), ("x.jsonl", "jsonl_extractions"), ("x_summary.json", "summary"), ("x_manual_review_summary.json", "manual_review_summary"), ("pilot_report.json", "pilot_report")]
    wanted = manifest.union(found, [(f"{tmp_path}/gone.json", "manual_review_summary")], found)
    entries = gate.file_entries(spark, wanted, str(tmp_path))
    doc = manifest.document(entries, "run", {"model": "m"})
    assert doc["status"] == "WARN" and doc["missing_paths"] == [f"{tmp_path}/gone.json"] and [f["json_top_level_type"] for f in doc["files"]] == ["list", "jsonl", "object", "object", None, None]
    assert doc["files"][1]["record_count"] == 2 and doc["files"][0]["relative_path"] == "metadata_a.json" and doc["run_context"]["model"] == "m"
    sinks.write_report(spark, doc, f"{tmp_path}/manifest")
    held = manifest.read(spark, f"{tmp_path}/manifest")
    here, gone = manifest.missing_reviews(held.select(F.explode("files").alias("f")).select("f.*"))
    assert here.count() == 1 and [r.path for r in gone.collect()] == [f"{tmp_path}/gone.json"]
    reviews = spark.createDataFrame([("PASS", 3, 3, 3, 0, 0, 0), (None, 2, 1, 0, 1, 1, 0)], "status string, total_records long, fully_checked long, pass long, reject long, revise long, unclear long")
    summaries = spark.createDataFrame([("PASS", 5), ("WARN", None)], "evaluation_status string, total_records long")
    row = pilot.analysis(held, manifest.entries_of(held), summaries, reviews, None).first()
    assert (row.recommendation, row.files, row.extraction_records, row.formal_records, row.total_records, row.reject) == ("FIX_TRACEABILITY", 6, 2, 5, 5, 1)
    fine = held.withColumn("status", F.lit("PASS")).withColumn("missing_paths", F.array().cast("array<string>"))
    told = lambda d, r: pilot.analysis(fine, manifest.entries_of(held), summaries, r, d).first()
    assert told("REVISE", reviews.limit(0)).next_actions == pilot.UNREVIEWED and told("REVISE", reviews).next_actions == pilot.NEXT["REVISE_BEFORE_SCALING"] and told("odd", reviews).recommendation == "INVESTIGATE_GATE_STATUS"
    paths = spark.createDataFrame([("x.jsonl",), ("old/x.jsonl",), ("/gone/x.jsonl",), ("no.txt",)], "path string")
    known = spark.createDataFrame([("/base/x.jsonl",), ("/base/old/x.jsonl",)], "path string")
    assert {r.path: r.resolved for r in manifest.resolved(paths, known, "/base").collect()} == {"x.jsonl": "/base/x.jsonl", "old/x.jsonl": "/base/x.jsonl", "/gone/x.jsonl": "/gone/x.jsonl", "no.txt": "no.txt"}


def test_questions(spark):
    papers = spark.createDataFrame([("p1", "a1"), ("p2", "a2"), ("p3", None)], "paper_id string, arxiv_id string")
    asked = [("q002", "?", "method", [2], [1], ["model"], "cite", None), ("q006", "?", "comparison", [3, 4], [1, 2], [], None, "n"), ("q007", "?", "source_lookup", [1, 2, 3, 4, 5], [1], [], None, None)]
    scaffold = spark.createDataFrame(asked, questions.SCAFFOLD)
    rows = {r.question_id: r for r in questions.table(papers, scaffold).collect()}
    assert rows["q002"].expected_source_arxiv_ids == ["a2"] and rows["q006"].expected_source_arxiv_ids == ["a1", "a2"] and rows["q007"].expected_source_arxiv_ids == ["a1", "a2"]
    assert (rows["q002"].evaluation_criteria, rows["q002"].notes, rows["q006"].notes, rows["q002"].expected_section_keywords) == ("cite", "", "n", ["model"])
    assert {r.question_id: r.expected_source_arxiv_ids for r in questions.table(papers.limit(1), scaffold).collect()}["q002"] == ["a1"]
    made = questions.table(papers).collect()
    assert len(made) == 8 and {r.question_type for r in made} == set(questions.KINDS) and all(r.evaluation_criteria for r in made)
    assert all(r.expected_source_arxiv_ids == [] for r in questions.table(papers.limit(0)).collect())
    with pytest.raises(Exception, match="unknown kind of question: odd"):
        questions.table(papers, spark.createDataFrame([("q", "?", "odd", [1], [1], [], None, None)], questions.SCAFFOLD)).collect()


def test_formal_summary(spark):
    run_ = {"run_id": "r", "created_at": "c", "backend": "fake", "model": "fake", "prompt_version": "v", "prompt_template_sha256": "h", "extraction_schema_version": "s"}
    source = {"arxiv_id": "1", "title": "t", "authors": ["A"], "categories": ["c"], "published": "p", "url": "u"}
    extraction = {f: "x" for f in records.EXTRACTION} | {"confidence": "low"}
    held = [{"source": source, "extraction": extraction, "run": run_}, {"source": source | {"authors": []}, "extraction": extraction | {"confidence": "certain"}, "run": run_ | {"model": " "}}, {"extraction": extraction, "run": run_}]
    rows = spark.createDataFrame([(n, json.dumps(r)) for n, r in enumerate(held, 1)], "line long, text string").select("line", F.parse_json("text").alias("record"))
    counts = {(r.field, r.value): r.records for r in records.group_counts(rows).collect()}
    assert counts[("confidence", "low")] == 2 and counts[("confidence", "certain")] == 1 and counts[("model", "<missing>")] == 1
    found = {r.kind: (r.records, r.lines) for r in records.finding_counts(records.findings(rows), 1).collect()}
    assert found["source.authors"] == (2, [2]) and found["invalid confidence"] == (1, [2]) and found["run.model"] == (1, [2])
    total = records.formal_summary(rows).first()
    assert (total.total, total.records_with_source, total.records_with_findings, total.status) == (3, 2, 2, "WARN")
    text = records.summary_text(rows, "x.jsonl", require_source=False)
    assert "Records: 3" in text and "source.authors" not in text and "run.model: 1 record(s) [2]" in text and text.endswith("Evaluation status: WARN")


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n[1]\n{"b": 2}\n')
    rows = readers.jsonl(spark, f"{tmp_path}/a.jsonl", permissive=True).orderBy("line").collect()
    assert [(r.line, r.bad) for r in rows] == [(1, False), (3, True), (4, True), (5, False)]
    (tmp_path / "ids.txt").write_text("# c\n 1705.1 # x\n\n2001.2\n")
    assert [r.id for r in readers.id_list(spark, f"{tmp_path}/ids.txt").orderBy("pos").collect()] == ["1705.1", "2001.2"]
    sinks.write_jsonl(spark.createDataFrame([(1, "x")], "z int, a string"), f"{tmp_path}/out")
    assert readers.json_lines(spark, f"{tmp_path}/out", "a string, z int").first() == ("x", 1)
    entries = gate.file_entries(spark, [(f"{tmp_path}/a.jsonl", "jsonl_extractions"), (f"{tmp_path}/none.json", "x")])
    got = {r.role: (r.exists, r.record_count) for r in entries.collect()}
    assert got == {"jsonl_extractions": (True, 4), "x": (False, None)} and gate.manifest_summary(entries).first().status == "WARN"


def test_atom_and_archives(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1705.1v1</id><title>A\n B</title><summary>S</summary><author><name>X Y</name></author><author><name> </name></author><category term="hep-ex"/><published>2017</published></entry></feed>'
    row = readers.atom(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (row.arxiv_id, row.title, row.authors, row.categories, row.url) == ("1705.1v1", "A B", ["X Y"], ["hep-ex"], "https://arxiv.org/abs/1705.1v1")
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w:gz") as archive:
        info = tarfile.TarInfo("main.tex")
        info.size = 3
        archive.addfile(info, io.BytesIO(b"abc"))
    blobs = spark.createDataFrame([("p", bytearray(held.getvalue())), ("q", bytearray(b"%PDF-1")), ("r", bytearray(b"\\documentclass{x}")), ("s", bytearray(b"???"))], "paper_id string, content binary")
    assert sorted((r.paper_id, r.status, r.text or "") for r in readers.sniff(blobs).collect()) == [("p", "latex_source", "abc"), ("q", "unavailable", ""), ("r", "latex_source", "\\documentclass{x}"), ("s", "error", "")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"a": 1}\noops\n')
    for _ in range(2):
        ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {r.bad: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("bad").count().collect()} == {"false": 1, "true": 1}
