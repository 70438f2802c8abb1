"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forest, frozen, pick, split_join
from .graph import components

#: Cosine of a link; tables; bits of each table's key, at least; vectors of the sample; members of a tile of a bucket.
COSINE, TABLES, BITS, SAMPLE, TILE = 0.98, 6, 10, 4096, 1024
#: Keys grow with the number of vectors, up to 30 bits; for each bit beyond BITS, half a neighbouring key is looked up as well.
MOST_BITS, PROBED = 30, 0.5
ROUNDS = 30


@dataclass
class Quantiser:
    """Principal directions, rotated so that the signs of the projections lose as little as possible."""

    mean: np.ndarray
    project: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int, seed: int = 0) -> Quantiser:
        """Iterative quantisation: alternately take signs and the rotation that fits them best (Procrustes)."""
        rng = np.random.default_rng(seed)
        mean = sample.mean(axis=0)
        _, _, directions = np.linalg.svd(sample - mean, full_matrices=True)
        dims = min(bits, sample.shape[1])
        parts = []
        while sum(p.shape[1] for p in parts) < bits:  # more bits than dimensions: another rotation
            basis = directions[:dims].T
            seen = (sample - mean) @ basis
            rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(seen @ rotation >= 0, 1.0, -1.0).T @ seen)
                rotation = (u @ v).T
            parts.append(basis @ rotation)
        return cls(mean, np.concatenate(parts, axis=1)[:, :bits])

    def keys(self, x: np.ndarray, tables: int, bits: int, probes: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tables) twice: of each table its bits of the code as a number, and the bits nearest to their threshold, as a mask."""
        seen = ((x - self.mean) @ self.project).reshape(len(x), tables, bits)
        weight = np.left_shift(1, np.arange(bits))
        near = np.argsort(np.abs(seen), axis=2)[:, :, :probes]
        return ((seen >= 0) * weight).sum(axis=2), weight[near].sum(axis=2)


def key_bits(classes: int, tile: int = TILE) -> tuple[int, int]:
    """(bits of a key, neighbouring keys looked up): so many bits that a bucket holds about a tile of the largest label's classes."""
    bits = min(MOST_BITS, max(BITS, math.ceil(math.log2(max(1, classes / tile)))))
    return bits, math.ceil(PROBED * (bits - BITS))


def usable(vector: Column, label: Column) -> Column:
    """Labelled, not null, not zero, every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, bits: int | None = None, tile: int = TILE) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Vectors equal in label and all components are one class from the start, however many. Codes come from a
    rotation learnt on a bounded sample (SAMPLE vectors); every class is entered in all tables under its label. Keys
    have as many bits as the largest label needs for buckets of about a tile (see key_bits()); longer keys part more
    links, so a class then also visits the buckets whose keys differ in one of its least certain bits. Classes at home
    in a bucket are compared with each other and with its visitors, by their vectors in double precision, and only where
    they meet first, so nothing is counted twice and no pair is written out: a task returns, of each member, how
    many vectors it links with and one edge of a spanning forest. A bucket of more than `tile` classes is cut
    into tiles, pairs of parts, for different tasks; none is capped. Pairs that meet in no table are missed; recall is
    measured in the tests.

    Vectors that are null, zero, hold null or non-finite components, or have no label, link with nothing. Vectors
    of different lengths don't link. Repeated rows count as copies of each other; null ids are returned with
    their component, and kept is false for them; so is the component of vectors that all have none. Ids decide nothing but
    names: a class is one label's, so an id that occurs under two labels joins nothing. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = pick(vectors, vec_id="vec_id:long", v=f"embedding:array<{kind}>", label="label:string")
    rows = rows.withColumn("ok", usable(F.col("v"), F.col("label")))
    good = rows.where("ok").drop("ok").withColumn("h", F.xxhash64("v"))
    classes = good.groupBy("label", "h", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("size", F.size("v"))
    classes = frozen(classes.withColumn("rep", F.monotonically_increasing_id()))
    most = classes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    bits, probes = key_bits(most, tile) if bits is None else (bits, math.ceil(PROBED * max(0, bits - BITS)))
    sample = classes.orderBy(F.xxhash64(F.lit("sample"), "rep"), "rep").limit(SAMPLE).select("v").collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    fitted = {}
    for size, own in by_size.items():
        x = np.array(own, np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        fitted[size] = Quantiser.fit(x / np.linalg.norm(x, axis=1, keepdims=True), tables * bits)
    shared = spark.sparkContext.broadcast(fitted)
    value = pa.float32() if kind == "float" else pa.float64()

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each class, table and bucket; lengths outside the sample share one bucket, which tiles cut up."""
        for batch in batches:
            for size in np.unique(batch.column("size").to_numpy()):
                own = batch.filter(pa.array(batch.column("size").to_numpy() == size))
                known = shared.value.get(int(size))
                none = np.zeros((len(own), tables), np.int64)
                keys, near = known.keys(_matrix(own.column("v")), tables, bits, probes) if known else (none, none)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).ravel()), tables).cast(pa.list_(pa.int32())) for x in (keys, near)]
                for t in range(tables if known else 1):
                    spots = [(False, keys[:, t], np.ones(len(own), bool))] + [(True, keys[:, t] ^ (1 << b), near[:, t] >> b & 1 > 0) for b in range(bits) if probes]
                    for visits, key, here in spots:
                        columns = [own.column("label"), own.column("size"), pa.array(np.full(len(own), t, np.int32)), pa.array(key.astype(np.int32)), pa.array(np.full(len(own), visits)), own.column("rep"), own.column("n"), *lists, own.column("v").cast(pa.list_(value))]
                        yield pa.RecordBatch.from_arrays(columns, ["label", "size", "t", "key", "visits", "rep", "n", "keys", "near", "v"]).filter(pa.array(here))

    schema = f"label string, size int, t int, key int, visits boolean, rep long, n long, keys array<int>, near array<int>, v array<{kind}>"
    entered = classes.select("label", "size", "rep", "n", "v").mapInArrow(enter, schema)
    bucket = ["label", "size", "t", "key"]
    held = entered.groupBy(*bucket).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    large = frozen(held.where("parts > 1"))
    dealt = entered.withColumn("parts", F.lit(1)) if large.isEmpty() else split_join(entered, large, bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))

    def compare(key: tuple, members: pa.Table) -> pa.Table:
        t, low, high = (k.as_py() for k in (key[2], key[4], key[5]))
        members = members.combine_chunks()
        rep, n, part = (members.column(c).to_numpy() for c in ("rep", "n", "part"))
        visits = members.column("visits").to_numpy()
        x = _matrix(members.column("v"))
        keys, bits_near = (members.column(c).combine_chunks().flatten().to_numpy().reshape(len(rep), -1) for c in ("keys", "near"))
        a, b = np.nonzero(part == low)[0], np.nonzero(part == high)[0]
        counts, edges = np.zeros(len(rep), np.int64), []
        for at in range(0, len(a), 256):
            own = a[at : at + 256]
            near = (x[own] @ x[b].T >= cosine) & ~(visits[own][:, None] & visits[b][None, :])
            if low == high:
                near &= own[:, None] != b[None, :]
            i, j = np.nonzero(near)
            first = meets_first(keys[own[i]], keys[b[j]], bits_near[own[i]], bits_near[b[j]], visits[own[i]], visits[b[j]], t)
            i, j = i[first], j[first]
            np.add.at(counts, own[i], n[b[j]])
            if low != high:
                np.add.at(counts, b[j], n[own[i]])
            edges = forest(edges + list(zip(own[i].tolist(), b[j].tolist())))
        root = dict(edges)
        at = np.nonzero(counts)[0]
        roots = [int(rep[root[k]]) if k in root else None for k in at.tolist()]
        return pa.table({"rep": pa.array(rep[at]), "links": pa.array(counts[at]), "root": pa.array(roots, pa.int64())})

    found = frozen(dealt.drop("parts", "other").groupBy(*bucket, "low", "high").applyInArrow(compare, "rep long, links long, root long"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.where("root IS NOT NULL").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    told = classes.join(linked, "rep", "left").join(named.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    told = told.select("label", "h", "v", "low", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    lowest = told.groupBy("component").agg(F.min("low").alias("component_id"))
    told = split_join(told, lowest, ["component"], "inner").drop("component", "low")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = split_join(good, told, ["label", "h", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def meets_first(a: np.ndarray, b: np.ndarray, near_a: np.ndarray, near_b: np.ndarray, visits_a: np.ndarray, visits_b: np.ndarray, t: int) -> np.ndarray:
    """Of pairs that meet in a bucket of table t: whether they meet nowhere before, by their keys and least certain bits of all tables.

    Two meet in a table if their keys are equal, or differ in one bit that is among the least certain ones of one of them.
    If it is for both, each visits the other's bucket; the one with the smaller key counts.
    """
    apart = a[:, :t] ^ b[:, :t]
    single = (apart & (apart - 1)) == 0
    before = (apart == 0) | (single & (apart & (near_a[:, :t] | near_b[:, :t]) == apart))
    home_near = np.where(visits_a, near_b[:, t], near_a[:, t])
    home = np.where(visits_a, b[:, t], a[:, t])
    twice = (visits_a ^ visits_b) & ((a[:, t] ^ b[:, t]) & home_near != 0)
    return ~before.any(axis=1) & ~(twice & (home > np.minimum(a[:, t], b[:, t])))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
