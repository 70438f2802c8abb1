"""Exact nearest vectors over inverted lists: blocks sorted by distance to a centre, left out where the triangle inequality allows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import top_k
from .shared import frozen, if_small, scratch

#: Vectors that centres are learnt from, and centres at most; they decide speed alone.
SAMPLE, LISTS, TURNS = 1 << 15, 4096, 8
#: Vectors of a block; blocks grow where there would be more than MOST_BLOCKS of them, as their bounds go to every task.
BLOCK, MOST_BLOCKS = 1024, 1 << 18
#: Queries of a tile, blocks that a query visits first, bounds looked at in one step.
TILE, FIRST, STEP = 256, 8, 4096
#: What bounds and sums may be wrong by, as a share of the squared norms.
SLACK = 1e-9


@dataclass
class VectorLists:
    """blocks (block, list, near, far, n, docs, v) in the shared folder: v holds n rows of width doubles, near and far are the least and
    the largest distance to the list's centre.

    Vectors get one more component, which brings them all to the norm `most`: of two points the nearer one has then the larger product.
    With cosine they are of unit length first, and most is 1.
    """

    spark: SparkSession
    path: str
    kind: str
    width: int
    most: float
    cosine: bool
    centres: np.ndarray

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"block long, list int, near double, far double, n int, docs array<{self.kind}>, v binary").parquet(self.path)

    @property
    def bounds(self) -> DataFrame:
        return self.blocks.select("block", "list", "near", "far", "n")


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows in a batch that goes to Python, for what is computed within: a block or a tile is a large row."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _filled(rows: DataFrame, ident: str) -> DataFrame:
    """Null components count as zero; null and empty vectors take no part."""
    return rows.select(ident, F.transform(F.col("v").cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0))).alias("v")).where("size(v) > 0")


def _matrix(column: pa.ListArray, width: int, cosine: bool) -> np.ndarray:
    """Vectors as rows, filled up with zeros to the width and cut beyond it; with cosine of unit length before."""
    sizes = np.asarray(column.value_lengths())
    x = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    x[np.arange(x.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    if cosine:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return np.ascontiguousarray(x[:, :width])


def _raised(x: np.ndarray, most: float | None) -> np.ndarray:
    """One more component: what a vector lacks to the norm `most`; zero for queries, which have none."""
    rest = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(most**2 - (x * x).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squared, 0))


def _centres(points: np.ndarray, count: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced points of the sample; a centre without points stays where it is."""
    centres = points[np.linspace(0, len(points) - 1, count).astype(int)].copy()
    for _ in range(TURNS):
        own = np.argmin(_distances(points, centres), axis=1)
        sums, held = np.zeros_like(centres), np.bincount(own, minlength=count)
        np.add.at(sums, own, points)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def _placed(rows: DataFrame, ident: str, index: VectorLists, most: float | None) -> DataFrame:
    """(id, v) -> (list, dist, id, v binary) in order of (list, dist): exchanged by ranges, so a list with most of the rows is many tasks'."""
    centres, width, cosine = index.spark.sparkContext.broadcast(index.centres), index.width, index.cosine

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), width, cosine)
                far = _distances(_raised(x, most), centres.value)
                own = np.argmin(far, axis=1)
                held = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own]), batch.column(ident), held], ["list", "dist", ident, "v"])

    out = rows.mapInArrow(place, f"list int, dist double, {ident} {dict(rows.dtypes)[ident]}, v binary")
    return out.repartitionByRange("list", "dist", F.xxhash64(ident)).sortWithinPartitions("list", "dist", ident)


def _packer(size: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows -> runs of `size` rows at most: of one list each with whole, else of neighbouring ones."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def row(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, dist = part.column(2).combine_chunks(), part.column("dist").to_numpy()
            packed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            flat = pa.array([b"".join(part.column("v").to_pylist())], pa.binary())
            cells = [pa.array([number]), pa.array([part.column("list")[0].as_py()], pa.int32()), pa.array([dist.min()]), pa.array([dist.max()]), pa.array([len(ids)], pa.int32()), packed, flat]
            return pa.RecordBatch.from_arrays(cells, ["block", "list", "near", "far", "n", "docs", "v"])

        for batch in batches:
            held = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            start, lists = 0, held.column("list").to_numpy()
            while start < len(lists):
                end = min(start + size, int(np.searchsorted(lists, lists[start], "right")) if whole else len(lists))
                if end == len(lists) and end - start < size:
                    break
                yield row(held.slice(start, end - start))
                start = end
            held = held.slice(start)
        if held is not None and held.num_rows:
            yield row(held)

    return pack


def build(vectors: DataFrame, cosine: bool = False, lists: int | None = None, block: int = BLOCK) -> VectorLists:
    """vectors(doc, v) -> lists, written once: by default as many as the root of the vectors' number, LISTS at most.

    Vectors of unequal length are filled up with zeros, which leaves products as they are over the shorter one. Null components count as
    zero, null and empty vectors take no part, zero vectors do; repeated rows are kept. Components must be finite. An empty table
    gives an index in which nothing is found. The directory of blocks and the centres are all that goes to every task.
    """
    spark = vectors.sparkSession
    rows = _filled(vectors, "doc")
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    told = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.sqrt(F.max(squared)).alias("most")).first()
    total, width = told["n"], told["width"] or 1
    most = 1.0 if cosine else (told["most"] or 0.0)
    if not np.isfinite(most):
        raise ValueError("vectors must be finite")
    count = max(1, min(LISTS, SAMPLE, lists or int(total**0.5)))
    share = min(SAMPLE, max(16 * count, 256))
    some = rows.orderBy(F.xxhash64("doc"), "doc").limit(share).select("v").toArrow().combine_chunks()
    batches = some.to_batches()
    centres = np.zeros((1, width + 1))
    if batches:
        points = _raised(_matrix(batches[0].column("v"), width, cosine), most)
        centres = _centres(points, min(count, len(points)))
    index = VectorLists(spark, scratch(spark, "vectors"), dict(rows.dtypes)["doc"], width, most, cosine, centres)
    size = max(block, -(-total // MOST_BLOCKS))
    packed = _placed(rows, "doc", index, most).mapInArrow(_packer(size, True), f"block long, list int, near double, far double, n int, docs array<{index.kind}>, v binary")
    packed.write.parquet(index.path)
    return index


def tiles(index: VectorLists, queries: DataFrame) -> DataFrame:
    """queries(q, v) -> (tile, qs, qv): neighbours go together, TILE of them at most, so that they visit the same blocks."""
    rows = _filled(queries, "q")
    packed = _placed(rows, "q", index, None).mapInArrow(_packer(TILE, False), f"block long, list int, near double, far double, n int, docs array<{dict(rows.dtypes)['q']}>, v binary")
    return frozen(packed.select(F.col("block").alias("tile"), F.col("docs").alias("qs"), F.col("v").alias("qv")))


def visits(index: VectorLists, asked: DataFrame, first: int | None = FIRST) -> DataFrame:
    """asked(tile, qs, qv, kth, seen) -> (tile, block, wants): the places in a tile of the queries that must visit a block.

    With `first` the blocks of the best bounds, so many a query. Else all blocks whose bound reaches a query's kth score, but those it has
    seen. No vector of a block lies nearer to a query than the difference of their distances to the centre, so none has a larger product.
    """
    held = index.bounds.toArrow().combine_chunks()
    lists, near, far, ids = (held.column(c).to_numpy() for c in ("list", "near", "far", "block"))
    shared = index.spark.sparkContext.broadcast((index.centres, lists, near, far, ids))
    width, most = index.width, index.most

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, lists, near, far, ids = shared.value
        for batch in batches:
            for n in range(batch.num_rows):
                x = np.frombuffer(batch.column("qv")[n].as_buffer()).reshape(-1, width)
                own = (x * x).sum(axis=1)[:, None] + most**2
                gaps = _distances(_raised(x, None), centres)
                bound = lambda lo, hi: (own - np.maximum(0, np.maximum(gaps[:, lists[lo:hi]] - far[lo:hi], near[lo:hi] - gaps[:, lists[lo:hi]])) ** 2) / 2  # noqa: B023, E731
                best, at = np.empty((len(x), 0)), np.empty((len(x), 0), dtype=np.int64)
                if first is None:
                    least = np.array(batch.column("kth")[n].as_py())[:, None] - SLACK * np.maximum(own, 1)
                    seen = np.array(batch.column("seen")[n].as_py()).reshape(len(x), -1)
                for lo in range(0, len(ids), STEP):
                    hi = min(lo + STEP, len(ids))
                    top = bound(lo, hi)
                    if first is None:
                        wanted = top >= least
                        for place in range(seen.shape[1]):
                            gone = (seen[:, place] >= lo) & (seen[:, place] < hi)
                            wanted[gone, seen[gone, place] - lo] = False
                        yield pairs(batch, n, ids[lo:hi], wanted)
                    else:
                        best, at = np.hstack([best, top]), np.hstack([at, np.broadcast_to(np.arange(lo, hi), top.shape)])
                        keep = np.argsort(-best, axis=1, kind="stable")[:, :first]
                        best, at = np.take_along_axis(best, keep, axis=1), np.take_along_axis(at, keep, axis=1)
                if first is not None:
                    used, back = np.unique(at, return_inverse=True)
                    wanted = np.zeros((len(x), len(used)), dtype=bool)
                    wanted[np.arange(len(x))[:, None], back.reshape(at.shape)] = True
                    yield pairs(batch, n, ids[used], wanted, used)

    def pairs(batch: pa.RecordBatch, n: int, ids: np.ndarray, wanted: np.ndarray, places: np.ndarray | None = None) -> pa.RecordBatch:
        keep = wanted.any(axis=0)
        block, query = np.nonzero(wanted[:, keep].T)
        ends = np.searchsorted(block, np.arange(keep.sum() + 1))
        wants = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(query.astype(np.int32)))
        spots = pa.array((places if places is not None else np.zeros(len(ids), dtype=np.int64))[keep])
        return pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), batch.column("tile")[n].as_py())), pa.array(ids[keep]), spots, wants], ["tile", "block", "place", "wants"])

    with batches_of(index.spark, 16):
        return frozen(asked.mapInArrow(choose, "tile long, block long, place long, wants array<int>"))


def _scores(index: VectorLists, asked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """asked(tile, qs, qv, kth), wanted(tile, block, wants) -> (tile, at, q, doc, score): of each visit the k best that reach kth."""
    width, kind = index.width, dict(asked.dtypes)["qs"].removeprefix("array<").removesuffix(">")
    joined = wanted.select("tile", "block", "wants").join(if_small(asked, 256), "tile").join(index.blocks.select("block", "docs", "v"), "block")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                wants = batch.column("wants")[n].values.to_numpy()
                x, y = (np.frombuffer(batch.column(c)[n].as_buffer()).reshape(-1, width) for c in ("qv", "v"))
                x = x[wants]
                qs, docs = batch.column("qs")[n].values.take(pa.array(wants)), batch.column("docs")[n].values
                scores = x @ y.T
                same = np.array(qs.to_pylist(), dtype=object)[:, None] == np.array(docs.to_pylist(), dtype=object)[None, :]
                least = np.array(batch.column("kth")[n].as_py())[wants][:, None] - SLACK * np.maximum((x * x).sum(axis=1)[:, None] + index_most, 1)
                row, col = np.nonzero((scores >= least) & ~same)
                got = scores[row, col]
                order = np.lexsort((np.array(docs.take(pa.array(col)).to_pylist()), -np.round(got, 9), row))
                row, col, got = row[order], col[order], got[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col, got = row[keep], col[keep], got[keep]
                cells = [pa.array(np.full(len(row), batch.column("tile")[n].as_py())), pa.array(wants[row].astype(np.int32)), qs.take(pa.array(row)), docs.take(pa.array(col)), pa.array(got)]
                yield pa.RecordBatch.from_arrays(cells, ["tile", "at", "q", "doc", "score"])

    index_most = index.most**2
    with batches_of(index.spark, 16):
        return frozen(joined.mapInArrow(multiply, f"tile long, at int, q {kind}, doc {index.kind}, score double"))


def two_rounds(index: VectorLists, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(best, first visits, later visits): what search() returns, and what it read for it."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    asked = tiles(index, queries)
    open_ = lambda value: F.transform("qs", lambda _: F.lit(value))
    asked = asked.withColumn("kth", open_(float("-inf")))
    first = visits(index, asked)
    found = _scores(index, asked, first, k)
    # Ranked by the query's place, so that equal ids on two vectors keep two bounds.
    reached = top_k(found.withColumn("one", F.struct("tile", "at")), k, "one").where(F.col("rank") == k).groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("at", "score"))).alias("reached"))
    been = first.select("tile", "place", F.explode("wants").alias("at")).groupBy("tile", "at").agg(F.collect_list("place").alias("spots"))
    been = been.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("at", "spots"))).alias("been"))
    bound = lambda _, i: F.coalesce(F.try_element_at("reached", i), F.lit(float("-inf")))
    asked = frozen(asked.drop("kth").join(reached, "tile", "left").join(been, "tile", "left").select("tile", "qs", "qv", F.transform("qs", bound).alias("kth"), F.flatten(F.transform("qs", lambda _, i: F.try_element_at("been", i))).alias("seen")))
    later = visits(index, asked, None)
    found = found.union(_scores(index, asked.drop("seen"), later, k))
    return top_k(found.select("q", "doc", "score"), k).select("q", "rank", "doc", "score"), first, later


def search(index: VectorLists, queries: DataFrame, k: int) -> DataFrame:
    """queries(q, v) -> (q, rank, doc, score) by dot product or cosine, exactly the k best; a vector never meets itself.

    Ties, to nine places, go to the smaller id. Each query visits its FIRST blocks of the best bounds; the k-th score found there is at most the k-th of
    all, so the other blocks are visited only where their bound reaches it. Tiles of queries meet blocks in joins, and a visit returns k rows
    a query at most. Bounds leave out what lies far from a query in clustered vectors; in vectors without clusters all blocks are visited.
    """
    return two_rounds(index, queries, k)[0]


def share_visited(index: VectorLists, first: DataFrame, later: DataFrame) -> DataFrame:
    """One row: queries' visits, and their share of all pairs of a query and a block."""
    each = first.union(later).select("tile", "block", F.explode("wants").alias("at"))
    return each.agg(F.count("*").alias("visits"), (F.count("*") / (F.count_distinct("tile", "at") * F.lit(index.bounds.count()))).alias("share"))
