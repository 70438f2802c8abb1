"""Quality classifier: gated attention over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, by_bytes, crc_remainder, pick, small_batches

#: Words of a passage; buckets and values of the word embedding; values of the encoder and of the attention.
PASSAGE, BUCKETS, EMBED, HIDDEN, GATE = 64, 4096, 8, 16, 8
#: Training: documents of each label, passages of a document at most, passes, step, documents of a step.
DOCS_PER_LABEL, PASSAGES_PER_DOC, EPOCHS, RATE, BATCH = 1200, 64, 12, 0.01, 32
CUT, CACHED = 0.3, 300_000
#: Per word: length, letters, capitals, digits, other signs, repeated signs, ends a sentence, not ASCII.
SHAPES = 8


def shape(word: bytes) -> tuple[float, ...]:
    text = word.decode("utf-8", "replace")
    letters = sum(c.isalpha() for c in text)
    upper = sum(c.isupper() for c in text)
    digits = sum(c.isdigit() for c in text)
    signs = len(text) - letters - digits
    same = sum(a == b and not a.isalnum() for a, b in zip(text, text[1:]))
    return min(len(text), 40) / 10, letters / len(text), upper / len(text), digits / len(text), signs / len(text), min(same, 8) / 2, float(text[-1] in ".!?"), float(len(word) > len(text))


class Words:
    """Numbers of words within a task, with their shapes and buckets; started anew when many."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.shapes, self.buckets = np.zeros((1024, SHAPES), np.float32), np.zeros(1024, np.int32)

    def number(self, word: bytes) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.known[word] = len(self.known)
            if n == len(self.shapes):
                self.shapes, self.buckets = np.concatenate([self.shapes] * 2), np.concatenate([self.buckets] * 2)
            self.shapes[n] = shape(word)
            self.buckets[n] = xxhash.xxh32_intdigest(word, 3) % BUCKETS
        return n

    def passages(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of all words, first word of each passage, statistics of each passage, passages of each text)."""
        if len(self.known) > CACHED:
            self.clear()
        split = [t.split() for t in texts]
        numbers = np.fromiter((self.number(w) for own in split for w in own), np.int64, sum(map(len, split)))
        counts = np.array([-(-len(own) // PASSAGE) for own in split], np.int64)
        first, at = [], 0
        for own in split:
            first += range(at, at + len(own), PASSAGE)
            at += len(own)
        starts = np.array(first, np.int64)
        if not len(starts):
            return numbers, starts, np.zeros((0, SHAPES + 3), np.float32), counts
        sizes = np.diff(np.append(starts, len(numbers))).astype(np.float32)
        sums = np.add.reduceat(self.shapes[numbers], starts, axis=0) / sizes[:, None]
        place = np.repeat(np.arange(len(starts)), sizes.astype(int))
        pair = np.unique(place * (1 << 32) + numbers)
        distinct = np.bincount(pair >> 32, minlength=len(starts)) / sizes
        again = np.zeros(len(numbers), np.float32)
        again[1:] = (numbers[1:] == numbers[:-1]) & (place[1:] == place[:-1])
        stats = np.column_stack([sums, distinct, np.add.reduceat(again, starts) / sizes, sizes / PASSAGE]).astype(np.float32)
        return self.buckets[numbers], starts, stats, counts


class AttentionModel:
    """Encoder tanh(xA + b); attention softmax of w(tanh(hV) * sigmoid(hU)); logit of the weighted encoding."""

    names = ("embed", "enc", "enc_bias", "tanh", "gate", "attend", "out", "bias")

    def __init__(self, rng: np.random.Generator):
        wide = SHAPES + 3 + EMBED
        make = lambda *shape, s: rng.normal(0, s, shape).astype(np.float64)
        self.embed, self.enc, self.enc_bias = make(BUCKETS, EMBED, s=0.05), make(wide, HIDDEN, s=0.3), np.zeros(HIDDEN)
        self.tanh, self.gate, self.attend = make(HIDDEN, GATE, s=0.3), make(HIDDEN, GATE, s=0.3), make(GATE, s=0.3)
        self.out, self.bias = make(HIDDEN, s=0.3), np.zeros(1)
        self.mean, self.scale = np.zeros(SHAPES + 3), np.ones(SHAPES + 3)
        self.empty = 0.5

    def encode(self, buckets: np.ndarray, starts: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(np.append(starts, len(buckets)))
        words = np.add.reduceat(self.embed[buckets], starts, axis=0) / sizes[:, None]
        x = np.column_stack([(stats - self.mean) / self.scale, words])
        return x, np.tanh(x @ self.enc + self.enc_bias)

    def pool(self, h: np.ndarray, counts: np.ndarray) -> tuple:
        """Of documents with passages only: (weights of passages, document vectors, parts for the gradient)."""
        t, g = np.tanh(h @ self.tanh), 1 / (1 + np.exp(-(h @ self.gate)))
        score = (t * g) @ self.attend
        first = np.cumsum(counts) - counts
        score = np.exp(score - np.repeat(np.maximum.reduceat(score, first), counts))
        weight = score / np.repeat(np.add.reduceat(score, first), counts)
        return weight, np.add.reduceat(weight[:, None] * h, first, axis=0), t, g, first

    def score(self, buckets: np.ndarray, starts: np.ndarray, stats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.empty)
        if len(starts):
            _, h = self.encode(buckets, starts, stats)
            z = self.pool(h, counts[counts > 0])[1]
            out[counts > 0] = 1 / (1 + np.exp(-(z @ self.out + self.bias)))
        return out

    def fit(self, bags: list[tuple], y: np.ndarray, rng: np.random.Generator) -> None:
        """bags: (buckets, starts, stats) of documents with passages. Adam on the logistic loss."""
        everything = np.concatenate([b[2] for b in bags])
        self.mean, self.scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
        m = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(bags), BATCH):
                rows = order[at : at + BATCH]
                own = [bags[k] for k in rows]
                lengths = np.array([len(b[0]) for b in own])
                counts = np.array([len(b[1]) for b in own])
                buckets = np.concatenate([b[0] for b in own])
                starts = np.concatenate([b[1] + o for b, o in zip(own, np.cumsum(lengths) - lengths)])
                grad = self._gradient(buckets, starts, np.concatenate([b[2] for b in own]), counts, y[rows])
                step += 1
                for k in self.names:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    setattr(self, k, getattr(self, k) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        for k in self.names:
            setattr(self, k, getattr(self, k).astype(np.float32))
        self.empty = float(y.mean())

    def _gradient(self, buckets, starts, stats, counts, y) -> dict[str, np.ndarray]:
        x, h = self.encode(buckets, starts, stats)
        weight, z, t, g, first = self.pool(h, counts)
        delta = (1 / (1 + np.exp(-(z @ self.out + self.bias))) - y) / len(y)
        out = {"out": z.T @ delta, "bias": np.array([delta.sum()])}
        dz = np.repeat(delta[:, None] * self.out, counts, axis=0)
        dweight = (dz * h).sum(axis=1)
        dscore = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, first), counts))
        out["attend"] = (t * g).T @ dscore
        dt, dg = dscore[:, None] * self.attend * g * (1 - t**2), dscore[:, None] * self.attend * t * g * (1 - g)
        out["tanh"], out["gate"] = h.T @ dt, h.T @ dg
        dh = (weight[:, None] * dz + dt @ self.tanh.T + dg @ self.gate.T) * (1 - h**2)
        out["enc"], out["enc_bias"] = x.T @ dh, dh.sum(axis=0)
        dwords = (dh @ self.enc.T)[:, SHAPES + 3 :]
        sizes = np.diff(np.append(starts, len(buckets)))
        out["embed"] = np.zeros_like(self.embed)
        np.add.at(out["embed"], buckets, np.repeat(dwords / sizes[:, None], sizes, axis=0))
        return out


def train(docs: DataFrame, labels: DataFrame, per_label: int = DOCS_PER_LABEL, per_doc: int = PASSAGES_PER_DOC, seed: int = 0) -> AttentionModel | None:
    """Learns from about per_label documents of each label, outside the held-out fold; None without any.

    The ids are sampled first, by hash. Passages are made where the texts lie, at most per_doc of each document,
    spread over the whole text; they alone reach the driver. per_label and per_doc are the bounds. Rows with one id
    count once.
    """
    known = pick(labels, doc_id="doc_id:long", y="quality:int").where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(crc_remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = bounded_sample(known, "y", per_label)
    texts = pick(docs, doc_id="doc_id:long", text="text:string").join(F.broadcast(ids), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in by_bytes(batches, "text"):
            bags = [_some(*words.passages([t or b""])[:3], per_doc) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [pa.array([b[k].ravel() for b in bags], kind) for k, kind in enumerate((pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float32())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *columns], ["doc_id", "y", "buckets", "starts", "stats"])

    small_batches(docs.sparkSession)
    bagged = texts.select("doc_id", "y", "text").mapInArrow(cut, "doc_id long, y int, buckets array<int>, starts array<long>, stats array<float>")
    rows = bagged.where("size(starts) > 0").groupBy("doc_id").agg(F.min(F.struct("y", "buckets", "starts", "stats")).alias("bag")).select("doc_id", "bag.*").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    bags = [(np.array(r["buckets"], np.int32), np.array(r["starts"], np.int64), np.array(r["stats"], np.float32).reshape(-1, SHAPES + 3)) for r in rows]
    rng = np.random.default_rng(seed)
    model = AttentionModel(rng)
    model.fit(bags, np.array([r["y"] for r in rows], np.float64), rng)
    return model


def _some(buckets: np.ndarray, starts: np.ndarray, stats: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most so many of one document's passages, spread over it."""
    at = np.unique(np.linspace(0, max(0, len(starts) - 1), most).astype(int)) if len(starts) else np.zeros(0, int)
    ends = np.append(starts, len(buckets))
    parts = [buckets[ends[k] : ends[k + 1]] for k in at]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum(sizes) - sizes, stats[at]


def score(docs: DataFrame, model: AttentionModel | None, cut: float = CUT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Every passage of the whole text is encoded and weighted. Texts without words (null, empty, blank) get the
    share of label 1 that training saw; without a model every score is 0.5. Held_out is false for a null doc_id.
    Repeated rows are each returned, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), shared.value
        for batch in by_bytes(batches, "text"):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            got = model.score(*words.passages(texts)) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(got, 0, 1).astype(np.float64))], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    got = pick(docs, doc_id="doc_id:long", text="text:string").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
