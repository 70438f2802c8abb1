"""Repeated passages, removed by windows that are doubled in length while they repeat in another document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, frozen, if_small, pick, small_batches, split_join, text_key

WINDOW = 50
#: The shortest windows that stand for longer ones have more than half as many words as this, and at most so many.
SHORTEST = 30
#: Words that a task holds at once; words whose hashes it remembers.
CHUNK, CACHED = 1_000_000, 400_000
#: Up to so many repeated windows of a level, a filter of 16 bits each (8 MB) goes to all tasks; beyond, they are joined to their documents.
FILTERED = 1 << 22
#: Windows around one short window in more rows than this are compared one by one, by aggregation.
MANY = 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PAIR = (np.uint64(0xC2B2AE3D27D4EB4F | 1), np.uint64(0xA24BAED4963EE407))


class _Hashes(dict):
    """Word -> 64-bit hash; a word's bytes decide, so equal words are equal everywhere."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word, 1)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads a hash over all bits; one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)])) if n else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of length words: a polynomial, with an odd base that can be divided out modulo 2 ** 64."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate(words * _powers(_BASE, n))])
    return _mix((sums[length:] - sums[:-length]) * _powers(inverse, n - length + 1))


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost smallest of each run of span values; runs are doubled until they are as long."""
    at, length = np.arange(len(x)), 1
    while length < span:
        step = min(length, span - length)
        left, right = at[:-step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        length += step
    return at


def levels(window: int) -> list[int]:
    """The lengths that are tried: each twice the one before, or what is left to the window's own length."""
    first = window
    while first > SHORTEST:
        first = -(-first // 2)
    out = [first]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def extended(short: np.ndarray, length: int, longer: int) -> np.ndarray:
    """Hashes of windows of the longer length, each made of two windows of the length before: its first and its last one."""
    n = max(0, len(short) - (longer - length))
    return _mix(short[:n] * _PAIR[0] + _mix(short[longer - length :][:n] ^ _PAIR[1]))


class Chunk:
    """The words of some whole documents, one after another, and the hashes of their windows up to one level."""

    def __init__(self, docs: list[tuple[int, int]], words: list[list[bytes]], keep: list, hashes: _Hashes, lengths: list[int], window: int):
        if len(hashes) > CACHED:
            hashes.clear()
        sizes = np.array([len(w) for w in words], np.int64)
        ids = np.array(docs, np.int64).reshape(-1, 2)
        self.docs, self.marks, self.keep = ids[:, 0], ids[:, 1], keep
        self.first = np.cumsum(sizes) - sizes
        own = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        self.owner = np.repeat(np.arange(len(docs)), sizes)
        self.window = window
        n = max(0, len(own) - window + 1)
        whole = self.owner[:n] == self.owner[window - 1 :] if n else np.zeros(0, bool)
        self.starts = np.nonzero(whole)[0]
        self.hashes = [window_hashes(own, lengths[0])]
        for length, longer in zip(lengths, lengths[1:]):
            self.hashes.append(extended(self.hashes[-1], length, longer))
        self.lengths = lengths

    def anchor(self, level: int) -> np.ndarray:
        """For each window of full length, the place of the level's window within it that has the smallest hash and stands for it."""
        return _least(self.hashes[level], self.window - self.lengths[level] + 1)[self.starts]

    def surviving(self, level: int, bloom: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(windows of full length, what stands for them) whose short window may occur in another document."""
        at = self.anchor(level)
        held = self.hashes[level][at]
        if bloom is not None:
            ok = in_filter(bloom, held)
        else:  # a hash of document and window: by chance it lets a window through, which is compared in vain
            own = np.array([(k, h) for k, known in enumerate(self.keep) for h in known], np.int64).reshape(-1, 2)
            ok = np.isin(_mix(held + self.owner[self.starts].astype(np.uint64) * _PAIR[1]), _mix(own[:, 1].view(np.uint64) + own[:, 0].astype(np.uint64) * _PAIR[1]))
        return self.starts[ok], at[ok]


def filter_bits(h: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bit) of each of the filter's functions."""
    for k in range(4):
        x = _mix(h + np.multiply(np.array([k + 1], np.uint64), _PAIR[0]))
        yield (x >> np.uint64(20)) % np.uint64(words), x & np.uint64(63)


def in_filter(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for word, bit in filter_bits(h, len(bloom)):
        found &= (bloom[word] >> bit) & np.uint64(1) > 0
    return found


def _chunks(batches: Iterator[pa.RecordBatch], lengths: list[int], window: int) -> Iterator[Chunk]:
    hashes, docs, words, keep, held = _Hashes(), [], [], [], 0
    for batch in by_bytes(batches, "text"):
        known = batch.column("keep").to_pylist() if "keep" in batch.schema.names else [None] * batch.num_rows
        for doc, mark, text, own_keep in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), known):
            own = (text or b"").split()
            if doc is not None and len(own) >= window:
                docs.append((doc, mark))
                words.append(own)
                keep.append(own_keep)
                held += len(own)
            if held >= CHUNK:
                yield Chunk(docs, words, keep, hashes, lengths, window)
                docs, words, keep, held = [], [], [], 0
    if docs:
        yield Chunk(docs, words, keep, hashes, lengths, window)


class Survivors:
    """The windows of one level that occur in several documents: a filter for all tasks, or, where they are many, lists joined to the documents."""

    def __init__(self, met: DataFrame, filtered: int = FILTERED):
        """met: (h, doc, mark) of the level's windows, once for each document."""
        found = met.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h")
        self.repeated = frozen(found)
        self.count = self.repeated.count()
        self.bloom, self.lists = None, None
        if self.count <= filtered:
            self.bloom = met.sparkSession.sparkContext.broadcast(build_filter(self.repeated, self.count))
        else:
            own = split_join(met, self.repeated, ["h"], "left_semi")
            self.lists = frozen(own.groupBy(F.col("doc").alias("doc_id"), "mark").agg(F.collect_set("h").alias("keep")))

    def reach(self, rows: DataFrame) -> DataFrame:
        """rows, with the survivors of each in a list where there is no filter; rows without survivors go then."""
        return rows if self.lists is None else rows.join(self.lists, ["doc_id", "mark"])


def build_filter(anchors: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter over the repeated windows' hashes, of 16 to 32 bits for each."""
    words = 1
    while words * 64 < 16 * max(1, count):
        words *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            for word, bit in filter_bits(h, words):
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array((np.uint64(1) << bit).view(np.int64))], ["word", "bits"])

    out = np.zeros(words, np.uint64)
    merged = anchors.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for r in merged.toLocalIterator():
        out[r["word"]] = np.array(r["bits"], np.int64).view(np.uint64)
    return out


def occurrences(rows: DataFrame, lengths: list[int], window: int, last: Survivors | None) -> DataFrame:
    """(h, doc, mark) of the windows of the last of the lengths that stand for windows which the level before let through, once for each document."""
    level, refine, bloom = len(lengths) - 1, last is not None, last and last.bloom

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _chunks(batches, lengths, window):
            at = own.anchor(level)
            if refine:
                starts, _ = own.surviving(level - 1, bloom and bloom.value)
                at = at[np.isin(own.starts, starts)]
            at = np.unique(at)
            h, owner = own.hashes[level][at], own.owner[at]
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(own.docs[owner[new]]), pa.array(own.marks[owner[new]])], ["h", "doc", "mark"])

    return (rows if last is None else last.reach(rows)).mapInArrow(run, "h long, doc long, mark long")


def repeats(docs: DataFrame, window: int = WINDOW, filtered: int = FILTERED, many: int = MANY) -> DataFrame:
    """(doc_id, mark, runs): starts of windows whose word sequence also starts in a document with a smaller doc_id, as [start, number, ...].

    Windows are tried at doubled lengths (see levels()): of each window of full length, the short window in it with the
    smallest hash stands for it (equal windows choose equal ones, about one position in fourteen). Those that occur
    in one document alone end there; around the others, windows of twice the length are made of two of the level
    before and tried in turn, until none is left or the full length is reached. There each task first settles
    what it can see itself: of equal windows in its share only those of the smallest document go on, so a passage in a
    third of all documents reaches the next task once per share. They are grouped by the short window, with all windows
    around it in one row. Short windows with more than `many` rows are not gathered: their windows are compared one by
    one, by a minimum that is combined before its shuffle. Windows are equal if the hashes of both levels are, 128
    bits in all; words are not compared. A passage longer than the window is a run of such windows.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    lengths, last = levels(window), None
    for k in range(max(1, len(lengths) - 1)):
        last = Survivors(occurrences(rows, lengths[: k + 1], window, last), filtered)
        if not last.count:
            return docs.sparkSession.createDataFrame([], "doc_id long, mark long, runs array<int>")
    level, bloom = max(0, len(lengths) - 2), last.bloom

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """known = 1: windows that repeat within the share, as runs. known = 0: the first of each, by short window, for the others."""
        for chunk in _chunks(batches, lengths, window):
            starts, at = chunk.surviving(level, bloom and bloom.value)
            if not len(starts):
                continue
            owner, anchor, full = chunk.owner[starts], chunk.hashes[level][at], chunk.hashes[-1][starts]
            place, doc = starts - chunk.first[owner], chunk.docs[owner]
            order = np.lexsort((doc, full, anchor))
            anchor, full, doc, place, mark = anchor[order], full[order], doc[order], place[order], chunk.marks[owner[order]]
            low = _lowest(doc, (anchor, full))
            again, first = doc > low, doc == low
            yield from _rows(_runs(doc[again], mark[again], place[again]))
            yield from _rows(_lists(doc[first], mark[first], place[first], anchor[first], full[first]))

    parts = frozen(last.reach(rows).mapInArrow(local, "anchor long, doc long, mark long, places array<int>, full array<long>"))
    out = parts.where("anchor IS NULL").select("doc", "mark", F.col("places").alias("runs"))
    first = parts.where("anchor IS NOT NULL")
    hot = frozen(first.groupBy("anchor").count().where(F.col("count") > many).select("anchor"))
    if not hot.isEmpty():
        each = first.join(if_small(hot), "anchor", "left_semi").select("anchor", "doc", "mark", F.explode(F.arrays_zip("places", "full")).alias("w")).select("anchor", "w.full", "doc", "mark", "w.places")
        low = each.groupBy("anchor", "full").agg(F.min("doc").alias("low"))
        out = out.union(split_join(each, low, ["anchor", "full"], "inner").where("doc > low").select("doc", "mark", F.array("places", F.lit(1))))
        first = first.join(if_small(hot), "anchor", "left_anti")
    settled = first.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "doc", "mark", "places", "full")
    out = out.union(settled.mapInArrow(_settle_runs, "doc long, mark long, runs array<int>"))
    return out.groupBy(F.col("doc").alias("doc_id"), "mark").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a mark that tells rows with one doc_id apart by their texts."""
    return pick(docs, doc_id="doc_id:long", text="text:string").withColumn("mark", text_key("doc_id", "text"))


def _new(columns: tuple) -> np.ndarray:
    """Where sorted rows differ from the row before in one of the columns."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _lowest(doc: np.ndarray, columns: tuple) -> np.ndarray:
    """The first, smallest doc of each row's group; rows are sorted by the columns, then doc."""
    return doc[np.maximum.accumulate(np.where(_new(columns), np.arange(len(doc)), 0))] if len(doc) else doc


def _grouped(new: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    offsets = pa.array(np.append(np.nonzero(new)[0], len(values)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind)))


def _runs(doc: np.ndarray, mark: np.ndarray, place: np.ndarray) -> tuple:
    """One row for each document, with runs of consecutive places as [start, number, ...]."""
    order = np.lexsort((place, mark, doc))
    doc, mark, place = doc[order], mark[order], place[order]
    if len(doc):
        distinct = _new((doc, mark, place))
        doc, mark, place = doc[distinct], mark[distinct], place[distinct]
    if not len(doc):
        return (doc, mark, None, None, None)
    start = _new((doc, mark, place - np.arange(len(place))))
    at = np.nonzero(start)[0]
    sizes = np.diff(np.append(at, len(place)))
    new = _new((doc[at], mark[at]))
    pairs = np.stack([place[at], sizes], axis=1).ravel()
    return doc[at][new], mark[at][new], None, _grouped(np.stack([new, np.zeros_like(new)], axis=1).ravel(), pairs, np.int32), None


def _lists(doc: np.ndarray, mark: np.ndarray, place: np.ndarray, anchor: np.ndarray, full: np.ndarray) -> tuple:
    """One row for each document and short window, with its windows in lists."""
    order = np.lexsort((place, mark, doc, anchor))
    doc, mark, place, anchor, full = doc[order], mark[order], place[order], anchor[order], full[order]
    if not len(doc):
        return (doc, mark, None, None, None)
    new = _new((anchor, doc, mark))
    return doc[new], mark[new], anchor[new], _grouped(new, place, np.int32), _grouped(new, full.view(np.int64), np.int64)


def _rows(made: tuple) -> Iterator[pa.RecordBatch]:
    doc, mark, anchor, places, full = made
    if len(doc):
        anchors = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64))
        fulls = pa.nulls(len(doc), pa.list_(pa.int64())) if full is None else full
        yield pa.RecordBatch.from_arrays([anchors, pa.array(doc), pa.array(mark), places, fulls], ["anchor", "doc", "mark", "places", "full"])


def _settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their short window; those that are complete are settled together, about CHUNK windows at once."""
    held, windows = [], 0
    for batch in batches:
        held.append(batch)
        windows += len(batch.column("places").flatten())
        if windows >= CHUNK:
            together = pa.Table.from_batches(held).combine_chunks()
            anchors = together.column("anchor").to_numpy()
            done = int(np.searchsorted(anchors, anchors[-1]))
            yield from _settle(together.slice(0, done))
            rest = together.slice(done)
            held, windows = rest.to_batches(), len(rest.column("places").combine_chunks().flatten())
    if held:
        yield from _settle(pa.Table.from_batches(held))


def _settle(members: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of the windows around each short window: those that a smaller document has as well."""
    if not members.num_rows:
        return
    members = members.combine_chunks()
    places, full = members.column("places").combine_chunks(), members.column("full").combine_chunks()
    sizes = np.asarray(places.value_lengths())
    doc, mark, anchor = (np.repeat(members.column(c).to_numpy(), sizes) for c in ("doc", "mark", "anchor"))
    place, h = places.flatten().to_numpy(), full.flatten().to_numpy()
    order = np.lexsort((doc, h, anchor))
    doc, mark, place, h, anchor = doc[order], mark[order], place[order], h[order], anchor[order]
    again = doc > _lowest(doc, (anchor, h))
    for row in _rows(_runs(doc[again], mark[again], place[again])):
        yield row.select(["doc", "mark", "places"]).rename_columns(["doc", "mark", "runs"])


def kept_words(text: bytes, runs: list[int] | None, window: int) -> tuple[list[bytes], int]:
    """(words that stay, number of words)."""
    words = text.split()
    if not runs:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    pairs = np.array(runs, np.int64).reshape(-1, 2)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 0] + pairs[:, 1] - 1 + window, -1)
    covered = np.add.accumulate(edge)[:-1] > 0
    return [w for w, c in zip(words, covered.tolist()) if not c], len(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW, filtered: int = FILTERED, many: int = MANY) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text, kept_sha256.

    Every window of every whole text is judged on the input. A document's first occurrence, that with the smallest
    doc_id, keeps its words. Null texts have no words. A row with a null doc_id is neither smaller nor larger than
    any: it is returned whole and removes nothing. Rows that share a doc_id are judged each by its own text, and none is
    smaller than the other. An empty table gives no rows.
    """
    found = repeats(docs, window, filtered, many)
    rows = keyed(docs).join(found, ["doc_id", "mark"], "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            out = []
            for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist()):
                kept, n = kept_words(text or b"", own, window)
                joined = b" ".join(kept)
                out.append((n, n - len(kept), joined.decode("utf-8", "replace"), hashlib.sha256(joined).hexdigest()))
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, p, array_to_string(list_slice(words, p, p + 49), ' ') AS seq
  FROM d, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS p)
), firsts AS (
  SELECT seq, min(doc_id) AS low FROM w GROUP BY seq
), gone AS (
  SELECT DISTINCT w.doc_id, unnest(range(w.p, w.p + 50)) AS i FROM w JOIN firsts USING (seq) WHERE w.doc_id > firsts.low
), n AS (
  SELECT doc_id, count(*) AS n_removed, list(i) AS gone FROM gone GROUP BY doc_id
), each AS (
  SELECT d.doc_id, unnest(d.words) AS word, generate_subscripts(d.words, 1) AS i FROM d
), kept AS (
  SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.i) AS text FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.i = gone.i
  GROUP BY each.doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
