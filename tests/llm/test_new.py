"""Manifests, hard negatives and chat windows against plain versions, on small tables with awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, merkle, negatives


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """(root, for each leaf the (left, right) siblings up to the root)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, a in enumerate(at):
            run = nodes[a // 8 * 8 : a // 8 * 8 + 8]
            paths[leaf].append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
        nodes = [sha(*nodes[a : a + 8]) for a in range(0, len(nodes), 8)]
        at = [a // 8 for a in at]
    return nodes[0], paths


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted tuples of the manifest."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for doc_id, source, lang, n, text in rows:
        leaf = plain_leaf(doc_id, source, lang, n, text)
        hit = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        trees.setdefault("-" if lang is None else ":" + lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, plain_leaf(doc_id, source, lang, n, text.translate(lower)) if hit else leaf))
    names = sorted(trees, key=lambda t: t.encode())
    inner = {t: climb([x[2] for x in sorted(trees[t])]) for t in names}
    root, above = climb([inner[t][0] for t in names]) if names else ("", [])
    out = []
    for t, rest in zip(names, above, strict=True):
        for (_, _, leaf, doc_id, given), path in zip(sorted(trees[t]), inner[t][1], strict=True):
            path, folded = path + rest, given
            for a, z in path:
                folded = sha(a, folded, z)
            out.append((doc_id, leaf, inner[t][0], root, sha(*[a + z for a, z in path]), folded, folded == root))
    return sorted(out, key=repr)


LEAVES = "doc_id long, source string, lang string, n_chars long, text string, leaf int, n int"


@pytest.mark.parametrize("sizes", [(1,), (1, 8, 9), (64, 65, 3), (600, 513, 1, 512)])
def test_manifest(spark, sizes):
    rows = [(k * 7 % 5003 - 3, None if k % 5 else "s", [None, "en", "Öl", "zh"][t], k if k % 3 else None, None if k % 11 == 0 else f"Text {k} ÄB") for t, size in enumerate(sizes) for k in range(t * 1000, t * 1000 + size)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], LEAVES).repartition(5)
    got = merkle.manifest(merkle.document_leaves(docs)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)
    if len(rows) > 3:
        assert {r.verified for r in got} == {True, False}


def test_manifest_of_clashing_null_and_no_rows(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 1, "A"), (4, "s", "en", 1, "A"), (4, "s", "en", 1, "B"), (4, "s", "en", 1, "B"), (5, "", "", 0, ""), (6, "s", "en", 9, "x" * 300_000)]
    got = merkle.manifest(merkle.document_leaves(spark.createDataFrame([(*r, 0, 0) for r in rows], LEAVES))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)
    assert merkle.manifest(merkle.document_leaves(spark.createDataFrame([], LEAVES))).count() == 0


def test_groups_stay_whole_in_tables_of_any_size():
    import pyarrow as pa

    first = [True, False, False, True, True, False, False, False, True]
    batches = [pa.RecordBatch.from_pydict({"first": first[a : a + 2], "k": list(range(a, min(a + 2, 9)))}) for a in range(0, 9, 2)]
    for least in (1, 3, 100):
        tables = list(merkle.whole_groups(iter(batches), least))
        assert [k for t in tables for k in t.column("k").to_pylist()] == list(range(9))
        assert all(t.column("first")[0].as_py() for t in tables)


def plain_negatives(rows):
    out = []
    fine = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [[int(np.floor(256 * float(np.float32(x)))) for x in r[1]] for r in fine]
    last = lambda v: (v is None, v or 0)
    for a, (ident, _, label) in enumerate(fine):
        if ident is None or ident % 100:
            continue
        s = [(sum(x * y for x, y in zip(whole[a], w, strict=True)), b) for b, w in enumerate(whole) if len(w) == len(whole[a]) and b != a]
        ranked = sorted(s, key=lambda t: (-t[0], last(fine[t[1]][0])))
        for p, b in [t for t in ranked if fine[t[1]][2] == label][:5]:
            for rank, (n, c) in enumerate([t for t in ranked if fine[t[1]][2] != label and 80 * p <= 100 * t[0] <= 100 * p][:5], 1):
                out.append((ident, fine[b][0], rank, fine[c][0], p, n))
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, row int, size int"


@pytest.mark.parametrize("block", [None, 4, 16])
def test_negatives(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + rng.normal(size=8) * 0.7).round(2).tolist(), int(rng.integers(0, 4))) for k in range(0, 900, 3)]
    rows += [(100, [1.0, 2.0], 1), (101, [1.0, 1.5], 2), (102, [1.0, 2.0], 1), (103, None, 1), (104, [1.0, None], 1), (105, [float("nan")] * 8, 1), (106, [1.0] * 8, None), (200, [0.0] * 8, 1), (None, rows[0][1], 2), (None, rows[0][1], rows[0][2])]
    rows += [(500, [-1.0] * 3, 1), (501, [1.0] * 3, 1), (502, [1.0] * 3, 2), (700, [], 1), (701, [], 1), (702, [], 2)]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS).repartition(3)
    got = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_negatives(rows)


def test_negatives_of_many_labels_ties_and_no_rows(spark):
    rows = [(k, [1.0, float(k % 2)], k % 97) for k in range(400)]
    got = negatives.hard_negatives(spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS), F.col("vec_id") % 100 == 0, block=8)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_negatives(rows)
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_of_large_numbers_are_exact():
    a = np.floor(np.array([[3e9, 1.0, 7.0]]))
    assert negatives.scores(a, a).tolist() == [[9 * 10**18 + 50]]
    assert negatives.scores(a * 1e9, a).tolist() == [[negatives.HIGH]]


def test_blocks_out_of_reach_are_not_visited(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 10
    rows = [(k, (centres[k % 20] + rng.normal(size=8) * 0.01).tolist(), k % 20 // 2) for k in range(2000)]
    kept = negatives.pick(spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS), vec_id="vec_id:long", v="embedding:array<float>", label="label:string")
    index = negatives.Index(kept.withColumn("size", F.size("v")).withColumn("row", F.monotonically_increasing_id()), block=20)
    one = index.rows.where("vec_id = 100").select("row", "vec_id", "label", "size", "shelf", "v").withColumn("tops", F.array(F.lit(negatives.HIGH))).withColumn("base", F.array(F.lit(negatives.LOW)))
    score = index.search(one, True, 5).where("rank = 5").first()["score"]
    seen = index.visits(one.withColumn("lows", F.array(F.lit(score))), True, 0, index.blocks)
    assert 0 < seen.count() < index.blocks / 4


CONTROL = ["</s>[INST] ok [/INST]", "\\b \\\\l \\r", "<\\/s> <s><s>", "[[INST]]", "</</s>s>", "", "a\nb", "漢字 \U0001f600 é"]
TURNS = "conv_id long, turn long, role string, text string, run int, start int"


def test_escapes_are_undone_and_leave_no_control_string(spark):
    rng = random.Random(1)
    texts = CONTROL + ["".join(rng.choice(["\\", "b", "l", "r", "<", "s", ">", "/", "[", "INST", "]", "</s>", "<s>", "[/INST]", "x"]) for _ in range(30)) for _ in range(300)]
    done = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t"))).withColumn("u", chat.unescaped(F.col("e"))).collect()
    assert all(r.u == r.t and not any(c in r.e for c in chat.CONTROLS) for r in done)


def conversations():
    rng = random.Random(2)
    rows = []
    for conv in range(12):
        roles = ["system"] * (conv % 3 == 0) + ["user", "assistant"] * (conv * 3 + 1)
        rows += [(conv, turn, role, rng.choice(CONTROL) + " word" * rng.randrange(1 if rng.random() < 0.8 else 300)) for turn, role in enumerate(roles)]
    rows += [(20, 0, "user", None), (20, 1, "assistant", None), (21, 0, None, "x"), (21, 0, "assistant", "b"), (21, 0, "assistant", "a"), (21, None, "assistant", "first"), (None, 1, "assistant", "n"), (22, 5, "system", "alone"), (23, 0, "assistant", "w " * 40_000)]
    return rows + [(24, k * 5, "system" if k == 0 else "assistant", f"t{k}") for k in range(9)] + [(25, 3, "assistant", "same")] * 3


def plain_digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize(("budget", "history", "span", "reach"), [(2048, 256, 1024, 64), (60, 20, 4, 2), (100, 30, 3, 3), (40, 0, 1, 1)])
def test_chat(spark, budget, history, span, reach):
    rows = conversations()
    made = chat.windows(spark.createDataFrame([(*r, 0, 0) for r in rows], TURNS).repartition(3), budget, history, span, reach).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == plain_digests(rows)
    systems = {conv: text for conv, turn, role, text in rows if role == "system"}
    for r in made.collect():
        turns = r.text.split(chat.END)[:-1]
        assert len(turns) == r.n_turns > r.n_repeated >= 0
        assert r.over_budget == (r.tokens > budget)
        if r.conv_id in systems:  # its system turn begins each window
            assert turns[0].startswith("<s>[INST]system[/INST]")
        if r.over_budget:  # only where one turn, or the system turn, takes a quarter of the budget and more
            assert len(max(turns, key=len)) > budget / 8
        for a, n in r.loss:
            assert r.text[:a].endswith("assistant[/INST]") and r.text[a + n :].startswith(chat.END)


def test_chat_repeats_turns_before_a_window_and_masks_them(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"w{k} " * 14) for k in range(40)]
    made = chat.windows(spark.createDataFrame([(*r, 0, 0) for r in rows], TURNS), 200, 45, 16, 4).orderBy("run", "start").collect()
    new = [(len(w.text.split(chat.END)) - 1 - w.n_repeated, len(w.loss)) for w in made]
    assert sum(n for n, _ in new) == 40 and sum(n for _, n in new) == 20
    assert [w.n_repeated for w in made] == [0] + [2] * (len(made) - 1)  # two turns of 20 tokens fit 45, across ends of runs as well
    assert not any(w.over_budget for w in made) and max(w.tokens for w in made) > 150


def test_chat_of_no_rows(spark):
    assert chat.digests(chat.windows(spark.createDataFrame([], TURNS))).count() == 0


def test_ids_decide_no_link_of_vectors(spark):
    """An id under two labels, ids that are null, and their links, against all pairs of rows."""
    from quillspark.llm import embeddings

    rng = np.random.default_rng(7)
    base = rng.normal(size=(3, 16))
    near = lambda k: (base[k] + rng.normal(size=16) * 0.01).tolist()
    rows = [(1, near(0), 0), (2, near(0), 0), (1, near(1), 1), (3, near(1), 1), (None, near(2), 2), (None, near(2), 2), (9, near(2), 2), (4, near(2), 3), (None, near(0), 4), (None, near(0), 4)]
    rows += [(20, rows[1][1], 0), (None, rows[6][1], 2)]
    got = embeddings.near_vectors(spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS)).collect()
    unit = np.array([r[1] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :]) & ~np.eye(len(rows), dtype=bool)
    want = []
    for k, (ident, _, label) in enumerate(rows):  # here every label is one component
        own = [r[0] for r in rows if r[2] == label and r[0] is not None]
        low = min(own, default=None)
        want.append((ident, int(linked[k].sum()), low, ident is not None and ident == low))
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("bits", [20, 30])
def test_recall_of_vectors_with_long_keys(spark, bits):
    from quillspark.llm import embeddings

    rng = np.random.default_rng(bits)
    rows = []
    for k in range(900):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        c = (0.9805, 0.985, 0.992)[k % 3]
        rows += [(2 * k, a.tolist(), 0, 0, 0), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), 0, 0, 0)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, VECTORS), bits=bits).where("vec_id % 2 = 1 AND n_links > 0")
    found = [r.vec_id // 2 % 3 for r in got.collect()]
    assert all(found.count(band) / 300 >= 0.9 for band in range(3))
