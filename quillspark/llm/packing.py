"""Packing documents into fixed windows by minimum bin slack over the multiset of remaining lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, frozen, pick, small_batches, totals_before

WINDOW, END_ID = 2048, 1
#: Runs of text whose ids a task remembers before it starts anew: a bound on memory, not on the work.
CACHED = 400_000
#: Pieces of one length that are numbered by one task, about: as many as a task has of other lengths.
NUMBERED = 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, equal to those of the tokenizer file.

    The file's pre-tokenizer never joins characters across a single space between two others, so runs between
    such spaces are encoded once and looked up afterwards. Texts with other white space beside a space, or with
    a special token's name, are encoded whole.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        letters = _byte_letters()
        vocabulary = {k: v for k, v in self.whole.get_vocab(with_added_tokens=False).items() if k not in self.special}
        ranks = {bytes(letters[c] for c in token): rank for token, rank in vocabulary.items()}
        self.runs = tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.seen = _Runs(self.runs)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.seen) > CACHED:
            self.seen.clear()
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise _Unsafe
            head = _ids(self.runs, first) if first else b""
            return head + b"".join(map(self.seen.__getitem__, rest))
        except _Unsafe:
            return _ids(self.runs, text)


class _Unsafe(Exception):
    """A run that begins or ends with white space: its neighbours matter."""


class _Runs(dict):
    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, run: str) -> bytes:
        if not run or run[0].isspace() or run[-1].isspace():
            raise _Unsafe
        out = self[run] = _ids(self.encoding, " " + run)
        return out


def _ids(encoding, text: str) -> bytes:
    return np.array(encoding.encode_ordinary(text), "<u4").tobytes()


def _byte_letters() -> dict[str, int]:
    """The usual letters of byte-level vocabularies: printable bytes stand for themselves, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Each document's ids with end_id at the end, cut in full windows and a rest: doc_id, start, length, ids_crc32, doc_tokens."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in by_bytes(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                out += [(doc, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 5, names)

    small_batches(docs.sparkSession)
    return pick(docs, doc_id="doc_id:long", text="text:string").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def fullest(counts: dict[int, int], order: list[int], capacity: int, first: int) -> dict[int, int]:
    """The multiset of remaining lengths that holds one piece of length first and comes closest to capacity.

    Subset sums are the bits of one whole number. Each length is added as often as pieces are left, by doubling,
    and the bits are kept after every step, so the counts of the best sum can be traced back. Steps end as soon
    as the window can be filled.
    """
    room, full = capacity - first, (1 << (capacity - first + 1)) - 1
    reach, steps = 1, []
    for length in order:
        left = min(counts[length] - (length == first), room // length if length <= room else 0)
        take = 1
        while left > 0:
            n = min(take, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & full
            left -= n
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {first: 1}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + n
            total -= length * n
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(multiset, windows filled with it) until no piece is left; counts: pieces of each length.

    Longest first: the longest length left seeds each multiset, which is repeated as long as its counts last, so
    the work depends on the number of different lengths, at most the window, and not on the number of pieces.
    """
    counts = {k: v for k, v in counts.items() if v}
    order = sorted(counts, reverse=True)
    out = []
    while order:
        used = fullest(counts, order, window, order[0])
        times = min(counts[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            counts[k] -= n * times
        order = [k for k in order if counts[k]]
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Of each length: (first number, first window, pieces a window, offset), by number."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    window = 0
    for multiset, times in patterns:
        offset = 0
        for length, n in multiset.items():
            out.setdefault(length, []).append((used.get(length, 0), window, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        window += times
    return out


def numbered(cut: DataFrame, most: int = NUMBERED) -> DataFrame:
    """cut with a number from 0 among the pieces of its length.

    Pieces of one length are dealt by hash to slices of about `most`; a small table has how many pieces lie in the
    slices before. A length that a third of all pieces share is numbered by as many tasks as others.
    """
    sizes = cut.groupBy("length").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("long").alias("slices"))
    dealt = cut.join(F.broadcast(sizes), "length")
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("slices"))).drop("slices")
    before = totals_before(dealt.groupBy("length", "slice").count(), "length", "slice", "count")
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("n", F.row_number().over(order))
    return ranked.join(before, ["length", "slice"]).withColumn("n", F.col("n") - 1 + F.col("before")).drop("slice", "before")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut at multiples of the window; what is left of each, whole, is packed by minimum bin slack.
    Only the counts of lengths, at most one per length up to the window, reach the driver; the plan it makes is as
    small. Null and empty texts are the end id alone. Repeated rows and null ids are packed like any other. An
    empty table gives no rows. Pieces are numbered by (doc_id, start, checksum), so a repeated task gives the same.
    """
    cut = frozen(pieces(docs, tokenizer, window, end_id))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = docs.sparkSession.sparkContext.broadcast(_places(plan(counts, window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {length: [p[0] for p in own] for length, own in places.value.items()}
        for batch in batches:
            sequences, offsets = [], []
            for length, n in zip(batch.column("length").to_pylist(), batch.column("n").to_pylist()):
                first, at, each, offset = places.value[length][bisect_right(starts[length], n) - 1]
                turn, slot = divmod(n - first, each)
                sequences.append(at + turn)
                offsets.append(offset + slot * length)
            kept = batch.drop_columns(["n"]) if hasattr(batch, "drop_columns") else batch
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*kept.schema.names, "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = numbered(cut).select(*names, F.col("n").cast("long").alias("n"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "sequence_id", "offset"]))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
