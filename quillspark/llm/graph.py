"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen, split_join


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): each node that reaches a smaller one, with the smallest it reaches.

    Alternating large-star and small-star steps: each node hands its larger (then its smaller) neighbours to the
    smallest node it knows, until no edge changes. The number of rounds grows with the logarithm of the longest
    chain. Every round is a grouped minimum, combined before its shuffle, and one join whose hot keys are split;
    nothing but a row count reaches the driver. Edges with a null end and loops are ignored.
    """
    now = frozen(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
        if mark == before or mark[0] == 0:
            return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
        before = mark
        now = frozen(_small_star(frozen(_large_star(now))))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    out = split_join(both, least, ["a"], "inner").where("b > a")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = split_join(down, least, ["a"], "inner")
    own = least.select("a", F.col("m").alias("b"))
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).where("a <> b").distinct()
