"""Near duplicates by SimHash fingerprints, found exactly with vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, forest, frozen, if_small, lower_ascii, pick, small_batches, split_join, taken, text_key
from .graph import components

#: The operator's defaults, which the contract of op2 asks for.
WORDS, BITS, SEED = 4, 4, 42
#: Fingerprints compared all with all at the bottom of a tree; members of a shard aimed at; rows of the sample; levels learnt from it.
LEAF, SHARD, SAMPLE, TOP = 128, 4096, 4096, 10
#: A shard of more fingerprints is searched in pairs of parts of so many. With more points than FEW, blocks are joined in twos.
TILE, FEW = 1 << 15, 1 << 29
#: Bits are counted in blocks of so many shingles, so a very long text needs no more memory.
BLOCK = 1 << 16
#: The pipeline's stage takes 5 words and also links texts whose sets of shingles have this Jaccard similarity.
STAGE_WORDS, SIMILARITY = 5, 0.8
#: Texts whose shingles say which are common, and of how many at most that is held. They decide speed alone.
COMMON_TEXTS, COMMON = 1 << 14, 1 << 18
#: Of a shingle's texts all are paired up to so many; where more share it, they meet in tiles of at most so many texts and shingles.
PAIRS, TILE_TEXTS, TILE_SHINGLES = 64, 2048, 1 << 20
#: Shared shingles that go to every task at once, and how often at most.
SENT, ROUNDS = 1 << 20, 16
#: Shingles that one product of matrices looks at.
COLUMNS = 2048


def shingles(text: bytes, words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, lower-cased, in blocks; a text shorter than a shingle is one, without words none."""
    split = lower_ascii(text).split()
    if not split:
        return
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split))) + np.arange(len(split))
    n = max(1, len(split) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a text: a bit is one if more than half of the shingles' hashes have it; without words, zero."""
    return simhash(shingles(text, words))


def simhash(blocks: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        n += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]) if n else 0


def needed(size: int, similarity: float) -> int:
    """Shingles that a text of so many shares with any text as similar, at least."""
    return math.ceil(similarity * size - 1e-9)


def rarest(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of a text's set of shingles, in ascending order, so many of the rarest that two similar texts have one of them in common.

    Shingles are ordered by their counts in common, then by hash. Two texts that share needed() of their shingles also
    share one among the first size - needed() + 1 of each: the first that they share.
    """
    hashes, counts = common
    at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
    ranks = np.where(hashes[at] == own, counts[at], 0) if len(hashes) else np.zeros(len(own), np.int64)
    return own[np.argsort(ranks, kind="stable")[: len(own) - needed(len(own), similarity) + 1]]


def common_shingles(docs: DataFrame, words: int, texts: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, counts) of the shingles that occur most often in a sample of about so many distinct texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = [shingle_set(t or b"", words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["hash"])

    texts, most, span = texts or COMMON_TEXTS, most or COMMON, 1 << 40
    small_batches(docs.sparkSession)
    rows = pick(docs, text="text:string").withColumn("mark", text_key("text"))
    low = F.pmod(F.xxhash64(F.lit("common"), "mark"), F.lit(span)) < F.lit(int(span * min(1.0, texts / max(1, docs.count()))))
    counts = frozen(rows.where(low).dropDuplicates(["mark"]).select("text").mapInArrow(run, "hash long").groupBy("hash").count().where("count > 1"))
    least, held = 1 << 62, 0
    for count, n in sorted(counts.groupBy("count").agg(F.count("*")).collect(), reverse=True):
        held += n
        if held > most:
            break
        least = count
    found = counts.where(F.col("count") >= least).toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("count").to_numpy()[order]


def fingerprints(docs: DataFrame, words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, mark) of each row, fp as a signed long; whole texts, null as empty. mark tells texts apart.

    With a similarity also size, how many shingles the text has, each once, and keys, the rarest of them.
    """
    common = None if similarity is None else docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            fps, sizes, keys = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                blocks = shingles(text or b"", words)
                if common:
                    blocks = list(blocks)
                    own = np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)
                    sizes.append(len(own))
                    keys.append(rarest(own, common.value, similarity).view(np.int64) if len(own) else own.view(np.int64))
                fps.append(simhash(blocks))
            out = [batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), batch.column("mark")]
            if common:
                out += [pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "fp", "mark", "size", "keys"][: len(out)])

    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id:long", text="text:string").withColumn("mark", text_key("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, mark long" + (", size long, keys array<long>" if common else ""))


def scattered(x: np.ndarray) -> np.ndarray:
    """Spreads numbers over 64 bits, one to one."""
    x = x.astype(np.uint64) + np.uint64(0x51ED2701A3C5E96B)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Tree:
    """One vantage-point tree, whose nodes are numbered like those of a heap; it is sent to every task.

    Points are compared by the bits of mask alone. Each inner node has a vantage point and a distance mu: points
    within mu go to the inside. Two points within radius that part company there are at most mu and more than
    mu - radius from the vantage point, by the triangle inequality, so inside points of that rim also go outside, and
    every pair within radius meets in a shard. The upper TOP levels are learnt from a bounded sample, mu being its
    median; below, and where the sample says nothing, a vantage point follows from its node's number and mu is
    half of the bits, so the tree takes some kilobytes however deep it is.
    """

    def __init__(self, sample: np.ndarray, mask: int, radius: int, depth: int):
        self.mask, self.radius, self.depth = np.uint64(mask), radius, depth
        top = min(depth, TOP)
        self.points = scattered(np.arange(1 << top)) & self.mask
        self.mus = np.full(1 << top, int(mask).bit_count() // 2, np.int16)
        self._grow(1, sample & self.mask, top)

    def _grow(self, name: int, points: np.ndarray, levels: int) -> None:
        cut = divide(points, self.radius, name) if levels and len(points) > 4 else None
        if cut is not None:
            self.points[name], self.mus[name] = cut[0], cut[1]
            self._grow(2 * name, points[cut[2]], levels - 1)
            self._grow(2 * name + 1, points[cut[3]], levels - 1)

    def shards(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in fps, shard) pairs: the home shard of each and those whose boundary it overlaps."""
        own, at, names = fps & self.mask, np.arange(len(fps)), np.ones(len(fps), np.int64)
        for _ in range(self.depth):
            known = names < len(self.points)
            slot = np.where(known, names, 0)
            points = np.where(known, self.points[slot], scattered(names) & self.mask)
            mus = np.where(known, self.mus[slot], int(self.mask).bit_count() // 2)
            far = np.bitwise_count(own[at] ^ points).astype(np.int16)
            inside, outside = far <= mus, far > mus - self.radius
            at = np.concatenate([at[inside], at[outside]])
            names = np.concatenate([2 * names[inside], 2 * names[outside] + 1])
        return at, names


def divide(points: np.ndarray, radius: int, seed: int) -> tuple | None:
    """(vantage point, mu, inside, outside with the rim), or None if no vantage point tried divides the points."""
    best = None
    for k in range(3):
        at = points[(seed * 7919 + k * 104729) % len(points)]
        far = np.bitwise_count(points ^ at).astype(np.int16)
        mu = int(np.median(far))
        inside, outside = far <= mu, far > mu - radius
        worst = max(int(inside.sum()), int(outside.sum()))
        if best is None or worst < best[0]:
            best = (worst, at, mu, inside, outside)
    return best[1:] if best[0] <= 0.9 * len(points) else None


def links(fps: np.ndarray, mask: int, radius: int, bits: int) -> list[tuple[int, int]]:
    """A spanning forest, as positions, of the links among fps that differ in at most radius bits of mask.

    Each node of the tree is divided until few points are left; pairs across a branch whose triangle bound exceeds
    the radius are never looked at.
    """
    out: list[tuple[int, int]] = []
    todo, own = [(1, np.arange(len(fps)))], fps & np.uint64(mask)
    while todo:
        name, at = todo.pop()
        cut = divide(own[at], radius, name) if len(at) > LEAF else None
        if cut is not None:
            todo += [(2 * name, at[cut[2]]), (2 * name + 1, at[cut[3]])]
        elif len(at) <= 2 * LEAF:
            near = np.bitwise_count(fps[at][:, None] ^ fps[at][None, :]) <= bits
            i, j = np.nonzero(np.triu(near, 1))
            out += zip(at[i].tolist(), at[j].tolist()) if len(i) <= 4 * len(at) else _walk(fps, at, bits)
        else:
            out += _walk(fps, at, bits)
    return forest(out)


def _walk(fps: np.ndarray, at: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Breadth first through points that no vantage point divides: a linked point is compared with unseen ones only."""
    left, out = at.copy(), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= bits
            found = left[near]
            out += [(int(x), int(y)) for y in found]
            queue += found.tolist()
            left = left[~near]
    return out


def masks(bits: int, points: int = 0) -> list[int]:
    """Bits of the 64, as masks, such that a pair within bits differs in at most one bit of some mask.

    With bits // 2 + 1 blocks, some block has at most one of the differing bits (pigeonhole). With bits + 1 blocks, two
    of them together have at most one: such pairs of blocks are longer, so that more points can be told apart.
    """
    count, joined = (bits // 2 + 1, 1) if points <= FEW else (bits + 1, 2)
    edges = [round(64 * k / count) for k in range(count + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(own) for own in combinations(blocks, joined)]


def link_edges(distinct: DataFrame, bits: int = BITS, shard: int = SHARD, tile: int = TILE, blocks: list[int] | None = None) -> DataFrame:
    """distinct (fp long), each once -> edges (a, b) between fingerprints that differ in at most bits bits.

    64 random bits lie too evenly for triangle bounds: at radius 4 most branches survive. Trees therefore look at
    blocks of the bits in which a linked pair differs in one bit at most (see masks()); with radius 1 bounds
    prune, and the full distance is tested at the bottom. Nothing is lost. Shards deepen, and blocks lengthen, with the
    number of fingerprints. A shard of more than two tiles, as a large family of near copies makes, is searched in
    pairs of parts by different tasks. Each returns a spanning forest of its links, never all pairs.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    blocks = blocks or masks(bits, total)
    depth = min(40, max(1, math.ceil(math.log2(max(2, total / shard)))))
    order = F.xxhash64(F.lit("vantage"), F.col("fp"))
    sample = np.array([r["fp"] for r in distinct.select("fp").orderBy(order, "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([Tree(sample, mask, 1, depth) for mask in blocks])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for block, tree in enumerate(trees.value):
                at, name = tree.shards(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int32)), pa.array(name), pa.array(fps[at])], ["block", "shard", "fp"])

    def search(key: tuple, members: pa.Table) -> pa.Table:
        fps = members.column("fp").to_numpy()
        at = np.array(links(fps.view(np.uint64), blocks[key[0].as_py()], 1, bits), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(fps[at[:, 0]]), "b": pa.array(fps[at[:, 1]])})

    dealt = distinct.select("fp").mapInArrow(deal, "block int, shard long, fp long")
    large = frozen(dealt.groupBy("block", "shard").count().where(F.col("count") > 2 * tile))
    dealt = dealt.withColumn("parts", F.lit(1)) if large.isEmpty() else dealt.join(if_small(large), ["block", "shard"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("count") / tile).cast("int"), F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.where("parts = 1 OR part <> other").select("block", "shard", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp")
    return dealt.groupBy("block", "shard", "low", "high").applyInArrow(search, "a long, b long")


def similar_edges(docs: DataFrame, each: DataFrame, words: int, similarity: float) -> DataFrame:
    """docs and each (fp, mark, size, keys) -> edges (a, b) between fingerprints that join what all pairs of texts as similar would join.

    Two similar texts share one of their rarest shingles (see rarest()). Where up to PAIRS texts share one, they are paired,
    and a pair goes that shares too few of these for its sizes. Where more do, a third of all texts perhaps, each
    is compared with the one that most others agree with, as the original of a family of near copies does. The similar
    ones are joined by that. The others are compared with all texts that met there (see left_edges). No pair is lost.
    """
    texts = one_of_each_mark(each)
    nodes = texts.select("mark", F.struct("mark", "fp").alias("node"), "size")
    held = shared_keys(texts.select("mark", "size", F.explode("keys").alias("key")))
    few = held.where(F.col("n") <= PAIRS).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("mark", "size"))).alias("texts"))
    left = few.select("texts", F.posexplode("texts").alias("at", "x"))
    alike = F.least("x.size", "y.size") >= F.lit(similarity) * F.greatest("x.size", "y.size") - 1e-6
    pairs = left.select("x", F.explode(F.slice("texts", F.col("at") + 2, PAIRS)).alias("y")).where(alike).groupBy("x", "y").agg(F.count("*").alias("common"))
    # x and y share the common ones, and of those beyond the keys at most what the one whose keys end first has there
    beyond = F.ceil(F.lit(similarity) * F.greatest("x.size", "y.size") - 1e-9) - 1
    enough = F.col("common") + beyond >= F.lit(similarity / (1 + similarity)) * (F.col("x.size") + F.col("y.size")) - 1e-6
    pairs = pairs.where(enough).select(F.col("x.mark").alias("x"), F.col("y.mark").alias("y"))
    many = held.where(F.col("n") > PAIRS).select("key", "mark", "n")
    degrees = many.groupBy("mark").agg(F.sum("n").alias("degree"))
    centres = many.join(degrees, "mark").groupBy("key").agg(F.max_by("mark", F.struct("degree", "mark")).alias("x"))
    met = split_join(many.select("key", F.col("mark").alias("y")), centres, ["key"], "inner").where("x <> y").select("x", "y").distinct()
    ends = split_join(pairs.withColumn("hub", F.lit(False)).union(met.withColumn("hub", F.lit(True))), nodes.select(F.col("mark").alias("x"), F.col("node").alias("a")), ["x"], "inner")
    ends = split_join(ends, nodes.select(F.col("mark").alias("y"), F.col("node").alias("b"), "size"), ["y"], "inner")
    ends = frozen(ends.select("a", "b", "size", "hub"))
    found = frozen(similar(docs, ends.where("a.fp <> b.fp").select("a", "b").distinct(), words, similarity))
    edges = found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    met = ends.where("hub").drop("hub")
    apart = frozen(met.where("a.fp <> b.fp").join(found, ["a", "b"], "left_anti"))
    return edges if apart.isEmpty() else edges.union(left_edges(docs, met, apart, words, similarity))


def one_of_each_mark(each: DataFrame) -> DataFrame:
    """(mark, fp, size, keys) of each text once. Rows of texts that occur several times alone are exchanged."""
    again = frozen(each.groupBy("mark").count().where("count > 1").select("mark"))
    if again.isEmpty():
        return each.select("mark", "fp", "size", "keys")
    again = if_small(again)
    first = each.join(again, "mark", "left_semi").groupBy("mark").agg(F.first(F.struct("fp", "size", "keys")).alias("own")).select("mark", "own.*")
    return each.join(again, "mark", "left_anti").select("mark", "fp", "size", "keys").union(frozen(first))


def shared_keys(keyed: DataFrame) -> DataFrame:
    """keyed (key, ...) with n, how many rows share the key, where there are several; frozen.

    Keys alone are exchanged to be counted. Most occur once, so those that don't go to every task, SENT at a time; only more
    than SENT * ROUNDS of them are joined.
    """
    # counted by another number, so that Spark exchanges both sides for the join alone and can split a hot key
    shared = keyed.groupBy(F.bitwise_not("key").alias("other")).agg(F.count("*").alias("n")).where("n > 1")
    shared = frozen(shared.select(F.bitwise_not("other").alias("key"), "n"))
    rounds = max(1, math.ceil(shared.count() / SENT))
    if rounds > ROUNDS:
        return frozen(keyed.join(shared, "key"))
    out = None
    for k in range(rounds):
        own = F.pmod(F.xxhash64("key"), F.lit(rounds)) == k
        found = frozen(keyed.where(own).join(F.broadcast(shared.where(own)), "key"))
        out = found if out is None else out.union(found)
    return out


def left_edges(docs: DataFrame, met: DataFrame, apart: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) between fingerprints for pairs of a text in apart and one in met that have the same a.

    Both have (a, b, size): a is the text that b was compared with. Each group is cut into tiles, and different tasks
    compare a tile of apart with one of met in full.
    """
    tiles = F.ceil(F.greatest(F.sum("size") / TILE_SHINGLES, F.count("*") / TILE_TEXTS)).cast("int")
    plan = apart.groupBy("a").agg(F.greatest(tiles, F.lit(1)).alias("lefts"))
    plan = frozen(plan.join(met.groupBy("a").agg(F.greatest(tiles, F.lit(1)).alias("rights")), "a"))
    sides = []
    for rows, own, other, left in ((apart, "lefts", "rights", True), (met, "rights", "lefts", False)):
        dealt = split_join(rows.drop("size"), plan, ["a"], "inner").withColumn("own", F.pmod(F.xxhash64("b.mark"), own).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        tile = (F.col("own"), F.col("other")) if left else (F.col("other"), F.col("own"))
        sides.append(dealt.select(F.col("a.mark").alias("centre"), tile[0].alias("i"), tile[1].alias("j"), F.lit(left).alias("apart"), F.col("b.mark").alias("mark"), F.col("b.fp").alias("fp")))
    dealt = sides[0].union(sides[1])
    dealt = split_join(dealt, texts_of(docs, dealt.select("mark")), ["mark"], "inner")

    def compare(members: pa.Table) -> pa.Table:
        first, fps = members.column("apart").to_numpy(), members.column("fp").to_numpy()
        sets = [shingle_set(t or b"", words) for t in members.column("text").cast(pa.binary()).to_pylist()]
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        at = np.array(across([sets[k] for k in left], [sets[k] for k in right], similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(fps[left[at[:, 0]]]), "b": pa.array(fps[right[at[:, 1]]])})

    return dealt.groupBy("centre", "i", "j").applyInArrow(compare, "a long, b long")


def across(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Positions (left, right) of sets as similar: as few pairs as join what all such pairs join.

    Only shingles of both sides count, and a set of which too few do is similar to none. How many each two sets share
    is a product of matrices, some columns at a time.
    """
    sides, sizes = (left, right), [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    if not all(size.sum() for size in sizes):
        return []
    shared = np.intersect1d(*[np.unique(np.concatenate(side)) for side in sides], assume_unique=True)
    kept, cells = [], []
    for side, size in zip(sides, sizes):
        hashes, owner = np.concatenate(side), np.repeat(np.arange(len(side)), size)
        known = np.isin(hashes, shared)
        hashes, owner = hashes[known], owner[known]
        kept.append(np.flatnonzero((size > 0) & (np.bincount(owner, minlength=len(size)) >= similarity * size - 1e-6)))
        place = np.full(len(size), -1)
        place[kept[-1]] = np.arange(len(kept[-1]))
        column, row = np.searchsorted(shared, hashes), place[owner]
        column, row = column[row >= 0], row[row >= 0]
        order = np.argsort(column, kind="stable")
        cells.append((column[order], row[order]))
    common = np.zeros((len(kept[0]), len(kept[1])), np.float32)
    for low in range(0, len(shared) if common.size else 0, COLUMNS):
        parts = []
        for (column, row), own in zip(cells, kept):
            cut = slice(*np.searchsorted(column, [low, low + COLUMNS]))
            parts.append(np.zeros((len(own), COLUMNS), np.float32))
            parts[-1][row[cut], column[cut] - low] = 1
        common += parts[0] @ parts[1].T
    out, label = [], np.arange(len(kept[1]))
    for row, own in enumerate(kept[0]):
        near = np.flatnonzero(common[row] / (sizes[0][own] + sizes[1][kept[1]] - common[row].astype(np.float64)) >= similarity)
        names, at = np.unique(label[near], return_index=True)
        out += [(int(own), int(kept[1][k])) for k in near[at]]
        if len(names) > 1:
            label[np.isin(label, names)] = names[0]
    return out


def texts_of(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(mark, text) of these marks, each once. Marks go to every task unless they are many, so that other texts are not exchanged."""
    texts = pick(docs, text="text:string").withColumn("mark", text_key("text"))
    return frozen(texts.join(if_small(frozen(marks.distinct())), "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text")))


def similar(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of pairs (a, b) of structs (mark, fp), those whose texts are as similar; texts are read again and joined by their marks."""
    texts = texts_of(docs, pairs.select("a.mark").union(pairs.select("b.mark")))
    both = split_join(pairs.withColumn("x", F.col("a.mark")), texts.toDF("x", "left"), ["x"], "inner").drop("x")
    both = split_join(both.withColumn("y", F.col("b.mark")), texts.toDF("y", "right"), ["y"], "inner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "left"):
            texts = [batch.column(c).cast(pa.binary()).to_pylist() for c in ("left", "right")]
            near, last, kept = [], None, None
            for x, y in zip(*texts):
                if x != last:
                    last, kept = x, shingle_set(x or b"", words)
                near.append(jaccard(kept, shingle_set(y or b"", words)) >= similarity)
            yield batch.select(["am", "af", "bm", "bf"]).filter(pa.array(near, pa.bool_()))

    small_batches(docs.sparkSession)
    flat = both.select(F.col("a.mark").alias("am"), F.col("a.fp").alias("af"), F.col("b.mark").alias("bm"), F.col("b.fp").alias("bf"), "left", "right")
    near = flat.mapInArrow(compare, "am long, af long, bm long, bf long")
    return near.select(F.struct(F.col("am").alias("mark"), F.col("af").alias("fp")).alias("a"), F.struct(F.col("bm").alias("mark"), F.col("bf").alias("fp")).alias("b"))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    own = list(shingles(text, words))
    return np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of shingles; 0 where one is empty."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def near_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Fingerprints within bits are linked; with a similarity, so are texts that reach it (see similar_edges).

    Texts without words (null, empty, blank) have fingerprint zero and link like any other. Rows with equal
    fingerprints, a third of all rows perhaps, are one node from the start, and links are between fingerprints: ids
    that occur twice link nothing. A row with a null doc_id gets its fingerprint and component but is never a
    component's name; the name is null where all ids are. Repeated rows are each returned. An empty table gives no rows.
    """
    each, named = _grouped(docs, words, bits, similarity)
    out = split_join(each, named.drop("class"), ["fp"], "inner")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, words: int, bits: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """(each row's doc_id, fp, mark; each fingerprint's class, named by a fingerprint, and its component_id)."""
    each = frozen(fingerprints(docs, words, similarity))
    distinct = frozen(each.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = link_edges(distinct, bits)
    if similarity is not None:
        edges = edges.union(similar_edges(docs, each, words, similarity))
    found = frozen(components(edges))
    members = found.union(found.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("fp"), "component")
    least = members.join(distinct, "fp").groupBy("component").agg(F.min("rep").alias("least"))
    told = split_join(members, least, ["component"], "inner")
    named = distinct.join(told, "fp", "left")
    return each.select("doc_id", "fp", "mark"), named.select("fp", F.coalesce("component", "fp").alias("class"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = STAGE_WORDS, bits: int = BITS, similarity: float | None = SIMILARITY) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id, rows without an id last.

    Rows are told apart by id and text. Of rows equal in both, one stays. Where few rows go, and none is repeated, their keys are
    sent to every task, and no text is exchanged.
    """
    each, named = _grouped(docs, words, bits, similarity)
    rows = each.groupBy("fp", "doc_id", "mark").agg(F.count("*").alias("n"))
    rows = split_join(rows, named.select("fp", "class"), ["fp"], "inner")
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "n")).alias("row"))
    plan = first.select(_row_key(F.col("row.doc_id"), F.col("row.mark")).alias("key"), F.when(F.col("row.n") == 1, 1).alias("copies"), F.lit(1).cast("long").alias("total"))
    plan, own = frozen(plan), _row_key(F.col("doc_id").cast("long"), text_key("text"))
    gone = frozen(rows.select(_row_key(F.col("doc_id"), F.col("mark")).alias("__gone")).join(plan, F.col("__gone") == F.col("key"), "left_anti"))
    if gone.limit(SENT + 1).count() > SENT or not plan.where("copies IS NULL").isEmpty():
        return taken(docs, own, plan)
    return docs.join(F.broadcast(gone), own == F.col("__gone"), "left_anti")


def _row_key(ident: Column, mark: Column) -> Column:
    return F.xxhash64(F.coalesce(ident.cast("string"), F.lit("none")), mark)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=WORDS, bits=BITS)
