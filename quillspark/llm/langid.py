"""Language identification by a small convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, by_bytes, crc_remainder, has_letter, pick, small_batches

#: Bytes of a window, filter widths, filters of each width, values of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Training: documents of each language and windows of each document at most, passes, step.
DOCS_PER_LANG, WINDOWS_PER_DOC, EPOCHS, RATE, BATCH = 400, 4, 6, 0.004, 64
#: Windows that go through the filters at once: the working set stays in cache.
BLOCK = 32
#: The stage of the pipeline rejects documents whose score is below so many times chance, one over the number of languages.
LEAST_RATIO = 1.2


def windows(text: bytes) -> np.ndarray:
    """The whole text as windows of fixed length, padded with zeros; neighbours share what the widest filter spans."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(text) - max(WIDTHS) + 1) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


@dataclass
class ByteConvNet:
    """Embedding, filters of several widths, maximum over the window, softmax."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray  # (widest * EMBED, all filters); a narrow filter has zeros beyond its width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], rng: np.random.Generator) -> ByteConvNet:
        widest, total = max(WIDTHS), FILTERS * len(WIDTHS)
        return cls(
            langs, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            (rng.normal(0, 0.25, (widest * EMBED, total)) * cls.shape()).astype(np.float32), np.zeros(total, np.float32),
            rng.normal(0, 0.1, (total, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
        )

    @staticmethod
    def shape() -> np.ndarray:
        """Ones where a filter has weights."""
        return np.concatenate([np.repeat(np.arange(max(WIDTHS) * EMBED)[:, None] < w * EMBED, FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        seen = self.embed[x].reshape(len(x), -1)
        n = WINDOW - max(WIDTHS) + 1
        wide = max(WIDTHS) * EMBED
        return np.lib.stride_tricks.as_strided(seen, (len(x), n, wide), (seen.strides[0], EMBED * seen.itemsize, seen.itemsize))

    def convolved(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        columns = self._columns(x)
        high = columns.reshape(-1, columns.shape[2]) @ self.filters
        return columns, high.reshape(len(x), columns.shape[1], -1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), BLOCK):
            _, high = self.convolved(x[at : at + BLOCK])
            hidden = np.maximum(high.max(axis=1) + self.bias, 0)
            out[at : at + BLOCK] = softmax(hidden @ self.out + self.out_bias)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the cross entropy; the gradient of a maximum goes to its place alone."""
        names = ("embed", "filters", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        keep, t = self.shape(), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                xb, yb = x[rows], y[rows]
                columns, high = self.convolved(xb)
                where = high.argmax(axis=1)
                raw = np.take_along_axis(high, where[:, None, :], axis=1)[:, 0] + self.bias
                hidden = np.maximum(raw, 0)
                delta = softmax(hidden @ self.out + self.out_bias)
                delta[np.arange(len(yb)), yb] -= 1
                delta /= len(yb)
                back = (delta @ self.out.T) * (raw > 0)
                grad = {"out": hidden.T @ delta, "out_bias": delta.sum(axis=0), "bias": back.sum(axis=0)}
                picked = columns[np.arange(len(xb))[:, None], where]  # window, filter, values under it
                grad["filters"] = np.einsum("bfd,bf->df", picked, back) * keep
                inner = back[:, :, None] * self.filters.T[None]
                grad["embed"] = np.zeros_like(self.embed)
                spots = where[:, :, None] + np.arange(max(WIDTHS))[None, None]
                letters = xb[np.arange(len(xb))[:, None, None], spots]
                np.add.at(grad["embed"], letters.ravel(), inner.reshape(-1, EMBED))
                t += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    step = RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - step).astype(np.float32))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(docs: DataFrame, per_lang: int = DOCS_PER_LANG, seed: int = 0) -> ByteConvNet | None:
    """Learns from about per_lang documents of each language, outside the held-out fold; None without any.

    The bound on the sample is the parameter per_lang. Of each sampled document some windows, spread over the whole
    text, are cut where the text lies; they alone reach the driver. Rows with one id count once.
    """
    labelled = pick(docs, doc_id="doc_id:long", text="text:string", lang="lang:string")
    labelled = labelled.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.coalesce(crc_remainder("doc_id", 3), F.lit(0)) != 1))
    ids = bounded_sample(labelled.select("doc_id", "lang"), "lang", per_lang).select("doc_id").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            own = []
            for text in batch.column("text").to_pylist():
                got = windows(text.encode("utf-8", "surrogatepass"))
                own.append([got[k].tobytes() for k in np.unique(np.linspace(0, len(got) - 1, WINDOWS_PER_DOC).astype(int))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(own, pa.list_(pa.binary()))], ["doc_id", "lang", "windows"])

    small_batches(docs.sparkSession)
    some = labelled.join(F.broadcast(ids), "doc_id").mapInArrow(cut, "doc_id long, lang string, windows array<binary>")
    rows = some.groupBy("doc_id").agg(F.min(F.struct("lang", "windows")).alias("own")).select("doc_id", "own.*").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["doc_id"]))
    langs, rng = sorted({r["lang"] for r in rows}), np.random.default_rng(seed)
    x = np.stack([np.frombuffer(w, np.uint8) for r in rows for w in r["windows"]])
    y = np.array([langs.index(r["lang"]) for r in rows for _ in r["windows"]])
    net = ByteConvNet.new(langs, rng)
    net.fit(x, y, rng)
    return net


def identify(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    A text's probabilities are the mean over its windows, weighted by their bytes; every byte of every text is
    seen. Null texts and texts without a letter, empty ones too, are `und` with score 0, as is all if nothing was
    there to learn from. Held_out is false for a null doc_id. Repeated rows are each returned; an empty table
    gives no rows. Ties go to the language that comes first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            got = verdicts(shared.value, batch.column("text").to_pylist())
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    got = pick(docs, doc_id="doc_id:long", text="text:string").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def verdicts(net: ByteConvNet | None, texts: list[str | None], most: int = 4096) -> list[tuple[str, float]]:
    """(language, score) of each text; windows of several texts, about most of them, go through the net together."""
    out: list[tuple[str, float]] = []
    part: list[tuple[int, int, np.ndarray]] = []  # place in out, bytes, windows

    def flush() -> None:
        probs, at = net.predict(np.concatenate([w for _, _, w in part])), 0
        for place, size, own in part:
            weight = np.full(len(own), WINDOW, np.float64)
            weight[-1] = max(1, size - (len(own) - 1) * (WINDOW - max(WIDTHS) + 1))
            mean = weight @ probs[at : at + len(own)] / weight.sum()
            at += len(own)
            out[place] = net.langs[int(mean.argmax())], float(min(1.0, mean.max()))
        part.clear()

    waiting = 0
    for text in texts:
        out.append(("und", 0.0))
        if net is not None and has_letter(text):
            data = text.encode("utf-8", "surrogatepass")
            part.append((len(out) - 1, len(data), windows(data)))
            waiting += len(part[-1][2])
        if waiting >= most:
            flush()
            waiting = 0
    if part:
        flush()
    return out


def keep_identified(docs: DataFrame, least: float | None = None) -> DataFrame:
    """docs without those whose language can't be told: `und`, or a score below least (by default LEAST_RATIO times chance)."""
    net = train(docs)
    least = least if least is not None else min(0.5, LEAST_RATIO / max(1, len(net.langs) if net else 1))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # names with dots can't be passed to tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            yield batch.filter(pa.array([score >= least for _, score in verdicts(shared.value, texts)], pa.bool_()))

    small_batches(docs.sparkSession)
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
