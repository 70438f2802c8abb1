"""Hard negatives by exact inner-product search over one-dimensional distance keys."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frozen, if_small, numbered, pick

#: Positives of an anchor, and negatives of a positive; parts of a component's unit; the least share of the positive's score, in hundredths.
POSITIVES, NEGATIVES, SCALE, SHARE = 5, 5, 256, 80
#: Rows of a block, least and, up to MOST_BLOCKS blocks, most; beyond, blocks grow, so that their directory is bounded.
BLOCK, LARGE_BLOCK, MOST_BLOCKS = 512, 4096, 1 << 19
#: Blocks of a shelf, about; blocks of a pivot; pivots; rows that pivots are chosen from.
SHELF, PER_PIVOT, PIVOTS, SAMPLE = 8, 4, 256, 4096
#: Blocks that an anchor visits first, and how much further each scan goes than the one before.
FIRST, GROWTH = 8, 16
#: Anchors that one task holds beside a block; cells of a matrix of anchors and blocks.
SLICE, CELLS = 4096, 1 << 22
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Keys:
    """Of vectors of one length: the largest squared norm, and the pivots, in the space with one more dimension."""

    most: float
    pivots: np.ndarray

    def augmented(self, x: np.ndarray) -> np.ndarray:
        """x with a last component that gives all rows one norm, so that a larger inner product is a smaller distance."""
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))[:, None]], axis=1)

    def distances(self, y: np.ndarray, pivots: int | None = None) -> np.ndarray:
        p = self.pivots[:pivots]
        return np.sqrt(np.maximum(0.0, (y * y).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * y @ p.T))


def spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """n points: the mean, then always the one farthest from those chosen; the first few are spread as well."""
    chosen = [points.mean(axis=0)]
    nearest = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        chosen.append(points[nearest.argmax()])
        nearest = np.minimum(nearest, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def whole(lists: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of one length as rows of whole numbers: each component times SCALE, rounded down."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(lists), size)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in double precision where no sum can pass 2^53, else in Python's integers, kept within a long."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.clip(exact, LOW + 1, HIGH).astype(np.int64)


def first_of_each(owner: np.ndarray, score: np.ndarray, ident: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each owner: higher scores first, then smaller ids, those without one last."""
    order = np.lexsort((ident, missing, -score, owner))
    own = owner[order]
    head = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    nth = np.arange(len(own)) - np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))
    return order[nth < k]


class Index:
    """Rows sorted by (size, shelf, pivot, distance to it), in blocks; and for each block its interval of keys.

    A shelf holds the labels of one hash, so a search within a label reads one shelf, and one across labels all but
    what it must not find. Shelves, pivots of a shelf and blocks follow the number of rows; the directory has at most some
    1.4 times MOST_BLOCKS entries, which every task gets.
    """

    def __init__(self, rows: DataFrame, block: int | None = None) -> None:
        spark = rows.sparkSession
        self.context = spark.sparkContext
        scaled = F.transform("v", lambda x: x.cast("double") * SCALE)
        squared = F.aggregate(scaled, F.lit(0.0), lambda n, x: n + F.pow(F.when(F.abs(x) < 1e15, F.floor(x).cast("double")).otherwise(x), F.lit(2.0)))
        stats = {r["size"]: (r["n"], r["most"]) for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.max(squared).alias("most")).collect()}
        total = sum(n for n, _ in stats.values())
        block = block or max(BLOCK, min(LARGE_BLOCK, total // 256), math.ceil(total / MOST_BLOCKS))
        shelves = max(1, total // (SHELF * block))
        sample: dict[int, list] = {}
        for r in rows.orderBy(F.xxhash64(F.lit("sample"), "row"), "row").limit(SAMPLE).select("size", "v").collect():
            sample.setdefault(r["size"], []).append(r["v"])
        self.keys = {}
        for size, (n, most) in stats.items():
            none = Keys(most, np.zeros((1, size + 1)))
            own = none.augmented(np.floor(SCALE * np.array(sample[size], np.float64).reshape(len(sample[size]), size))) if size in sample else none.pivots
            self.keys[size] = Keys(most, spread_out(own, min(PIVOTS, math.ceil(n / (PER_PIVOT * block)))))
        shared = self.context.broadcast(self.keys)
        rows = rows.withColumn("shelf", F.pmod(F.xxhash64("label"), F.lit(shelves)).cast("int"))
        held = rows.groupBy("size", "shelf").agg(F.ceil(F.count("*") / (PER_PIVOT * block)).cast("int").alias("pivots"))
        rows = rows.join(if_small(held), ["size", "shelf"])
        names = ["row", "vec_id", "label", "size", "shelf", "v"]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = np.stack([batch.column("size").to_numpy(), batch.column("pivots").to_numpy()], axis=1)
                for size, pivots in np.unique(kinds, axis=0):
                    own = batch.filter(pa.array((kinds == (size, pivots)).all(axis=1)))
                    keys = shared.value[int(size)]
                    apart = keys.distances(keys.augmented(whole(own.column("v"), int(size))), int(pivots))
                    best = apart.argmin(axis=1)
                    columns = [own.column(c) for c in names] + [pa.array(best.astype(np.int32)), pa.array(apart[np.arange(len(best)), best])]
                    yield pa.RecordBatch.from_arrays(columns, [*names, "pivot", "distance"])

        kind = rows.schema["v"].dataType.simpleString()
        placed = rows.select(*names, "pivots").mapInArrow(place, f"row long, vec_id long, label string, size int, shelf int, v {kind}, pivot int, distance double")
        placed = frozen(placed.withColumn("cell", F.concat_ws("/", "size", "shelf", "pivot")))
        stored = numbered(placed, "cell", ["distance", "row"]).withColumn("block", F.concat_ws("/", "cell", F.expr(f"at div {block}")))
        self.rows = frozen(stored.drop("cell", "at", "n"))
        entries = self.rows.groupBy("block", "size", "shelf", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
        table = entries.toArrow().sort_by([("size", "ascending"), ("shelf", "ascending"), ("pivot", "ascending"), ("low", "ascending")])
        self.blocks = len(table)
        self.directory = self.context.broadcast({c: table.column(c).to_numpy() for c in table.column_names})

    def visits(self, state: DataFrame, same: bool, start: int, end: int) -> DataFrame:
        """state, once for each block that is among its nearest start..end ones and can still hold what it wants.

        By the triangle inequality a row of a block is between |d - its key interval| and d plus the interval's end away,
        where d is the anchor's distance to the pivot; so its score lies between two bounds. An anchor's blocks are those whose bounds
        meet one of its wants, best bound first.
        """
        shared, directory = self.context.broadcast(self.keys), self.directory
        schema = state.schema

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = directory.value
            for batch in batches:
                sizes, shelf = batch.column("size").to_numpy(), batch.column("shelf").to_numpy()
                for size in np.unique(sizes):
                    here = np.nonzero(d["size"] == size)[0]
                    for at in np.array_split(mine := np.nonzero(sizes == size)[0], max(1, math.ceil(len(mine) * len(here) / CELLS))):
                        own = batch.take(pa.array(at))
                        keys = shared.value[int(size)]
                        x = whole(own.column("v"), int(size))
                        norm = (x * x).sum(axis=1)[:, None] + keys.most
                        apart = keys.distances(np.pad(x, ((0, 0), (0, 1))))[:, d["pivot"][here]]
                        near = np.maximum(0.0, np.maximum(apart - d["high"][here], d["low"][here] - apart))
                        slack = norm * 1e-9 + 1e-6
                        most, least = (norm - near**2) / 2 + slack, (norm - (apart + d["high"][here]) ** 2) / 2 - slack
                        fits, still = np.zeros(most.shape, bool), np.zeros(most.shape, bool)
                        tops, base, lows = (np.array(own.column(c).to_pylist(), np.float64).reshape(len(own), -1) for c in ("tops", "base", "lows"))
                        for w in range(tops.shape[1]):
                            under = least <= tops[:, w : w + 1]
                            fits |= under & (most >= base[:, w : w + 1])
                            still |= under & (most >= lows[:, w : w + 1])
                        if same:
                            fits &= d["shelf"][here][None, :] == shelf[at][:, None]
                        order = np.argsort(np.where(fits, -most, np.inf), axis=1, kind="stable")
                        nth = np.empty_like(order)
                        np.put_along_axis(nth, order, np.arange(order.shape[1])[None, :], axis=1)
                        i, j = np.nonzero(fits & still & (nth >= start) & (nth < end))
                        for a in range(0, len(i), SLICE):
                            named = pa.array(d["block"][here[j[a : a + SLICE]]], pa.string())
                            yield pa.RecordBatch.from_arrays([*own.take(pa.array(i[a : a + SLICE])).columns, named], [*own.schema.names, "block"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        return state.mapInArrow(choose, f"{fields}, block string")

    def search(self, state: DataFrame, same: bool, k: int) -> DataFrame:
        """state (row, label, size, shelf, v, tops, base) -> (anchor row, want, rank, score, vec_id, row): for each want the first k rows
        of the anchor's label (or of others, unless `same`) with base <= score <= top, exactly.

        Scans go outward: the nearest FIRST blocks, then always GROWTH times as many. After each, the k-th score found so
        far raises what a want still asks for, and blocks that cannot reach it are left out; when all blocks have been
        considered, what was found is certified.
        """
        state = frozen(state.withColumn("lows", F.col("base")))
        found, start, end = None, 0, FIRST
        while True:
            visits = frozen(self.visits(state, same, start, end))
            held = visits.groupBy("block").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
            held = if_small(frozen(held))
            dealt = visits.join(held, "block").withColumn("slice", F.pmod(F.xxhash64("row"), "slices").cast("int")).drop("slices")
            blocks = self.rows.select("block", "row", "vec_id", "label", "v", "size").join(held, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
            new = dealt.groupBy("block", "slice").cogroup(blocks.groupBy("block", "slice")).applyInArrow(_scorer(same, k), "anchor long, want int, score long, vec_id long, row long")
            best = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
            every = new if found is None else found.drop("rank").unionByName(new)
            found = frozen(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
            if end >= self.blocks:
                return found
            kth = found.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("want", "score"))).alias("kth"))
            raised = F.transform("base", lambda low, w: F.greatest(low, F.coalesce(F.element_at("kth", w), low)))
            state = frozen(state.join(kth, state["row"] == kth["anchor"], "left").withColumn("lows", F.coalesce(F.when(F.col("kth").isNotNull(), raised), F.col("base"))).drop("anchor", "kth"))
            start, end = end, end * GROWTH


def _scorer(same: bool, k: int):
    def score(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor", "want", "score", "vec_id", "row", "missing")}
        if len(anchors) and len(rows):
            size = anchors.column("size")[0].as_py()
            ids = rows.column("vec_id").combine_chunks()
            missing, ident = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            row, anchor = rows.column("row").to_numpy(), anchors.column("row").to_numpy()
            _, codes = np.unique(np.array(anchors.column("label").to_pylist() + rows.column("label").to_pylist(), object), return_inverse=True)
            x = whole(rows.column("v"), size)
            tops, lows = (np.array(anchors.column(c).to_pylist(), np.int64).reshape(len(anchors), -1) for c in ("tops", "lows"))
            vectors = anchors.column("v").combine_chunks()
            for at in range(0, len(anchors), 256):
                to = min(len(anchors), at + 256)
                s = scores(whole(vectors.slice(at, to - at), size), x)
                allowed = (codes[at:to][:, None] == codes[len(anchors) :][None, :]) == same
                if same:
                    allowed &= anchor[at:to][:, None] != row[None, :]
                for w in range(tops.shape[1]):
                    i, j = np.nonzero(allowed & (s <= tops[at:to, w][:, None]) & (s >= lows[at:to, w][:, None]))
                    kept = first_of_each(i, s[i, j], ident[j], missing[j], k)
                    i, j = i[kept], j[kept]
                    for c, values in zip(out, (anchor[at + i], np.full(len(i), w, np.int32), s[i, j], ident[j], row[j], missing[j]), strict=True):
                        out[c].append(values)
        kinds = {"anchor": np.int64, "want": np.int32, "score": np.int64, "vec_id": np.int64, "row": np.int64, "missing": bool}
        full = {c: np.concatenate(v) if v else np.zeros(0, kinds[c]) for c, v in out.items()}
        gone = full.pop("missing")
        return pa.table({c: pa.array(v, mask=gone) if c == "vec_id" else pa.array(v) for c, v in full.items()})

    return score


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE, block: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on vec_id. An anchor's positives are the first rows of its label, by inner product of whole
    numbers (see whole()), then by id; a positive's negatives the first of other labels whose score is at most the positive's and at
    least `share` hundredths of it. Both are searched in one index (see Index), exactly.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do those with one beyond
    1e150, whose square is not finite. Only vectors of one length are compared. Repeated rows are rows of their own, so an id that occurs
    twice can be its own positive; ties in score and id are broken by place, which shows in no column. Null ids come last among ties.
    A negative positive score has no negatives. Scores beyond a long are kept at its end. An empty table gives no rows.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = pick(vectors, vec_id="vec_id:long", v=f"embedding:array<{kind}>", label="label:string")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150)))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    rows = frozen(rows.withColumn("size", F.size("v")).withColumn("row", F.monotonically_increasing_id()))
    index = Index(rows, block)
    anchors = index.rows.where(F.coalesce(is_anchor, F.lit(False))).select("row", "vec_id", "label", "size", "shelf", "v")
    longs = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    near = index.search(anchors.withColumn("tops", longs(HIGH)).withColumn("base", longs(LOW)), True, positives)
    least = F.expr(f"transform(tops, s -> if(s < 0, s + 1, s div 100 * {share} + ((s % 100) * {share} + 99) div 100))")
    ranked = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    wanted = anchors.join(ranked, anchors["row"] == ranked["anchor"]).withColumn("tops", F.col("p.score"))
    far = index.search(wanted.withColumn("base", least).drop("anchor", "p"), False, negatives)
    told = near.select("anchor", (F.col("rank") - 1).alias("want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    far = far.select("anchor", "want", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = far.join(told, ["anchor", "want"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows in DuckDB's SQL, by comparing each anchor with every row.
ORACLE = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM positives p JOIN scored s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(given.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)
