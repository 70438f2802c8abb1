"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, frozen, if_small, pick, taken, text_key, totals_before

#: Target entropy as a share of the highest (equal weights), repetitions of a document at most, rows of a block.
ENTROPY, MOST_REPEATS, BLOCK_ROWS = 0.95, 4.0, 1024
#: The stage of the pipeline repeats nothing: a source that would be repeated is taken whole, once.
STAGE_ENTROPY, STAGE_REPEATS = 0.9, 1.0
SEED = 17


def words(column: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(f"[^{SPACE_CLASS[1:-1]}]+")).cast("long")


def tempered(shares: list[float], exponent: float) -> list[float]:
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = math.fsum(raised)
    return [r / total for r in raised]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def bisect(fits, steps: int = 60) -> float:
    """The smallest exponent in [0, 1] that fits, if 1 fits; fits must be monotone."""
    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def weights(tokens: dict[str, int], budget: float, target: float, most_repeats: float) -> tuple[dict[str, float], float, float]:
    """(weight of each source, exponent, budget) by temperature.

    The exponent is lowered from 1, where weights are the shares, until the entropy reaches target times the
    highest, but not so far that a source would be repeated more than most_repeats times within the budget. If
    most_repeats is 1 or less, no source can give more than it has: the budget shrinks to the largest one at
    which the tempered weights still repeat nothing beyond that.
    """
    names = sorted(k for k, n in tokens.items() if n > 0)
    if not names:
        return {}, 1.0, 0.0
    total = sum(tokens[k] for k in names)
    shares = [tokens[k] / total for k in names]
    goal = target * math.log(len(names))
    high = lambda a: entropy(tempered(shares, a)) <= goal  # noqa: E731  smaller exponents are more even
    repeats = lambda a: max(w * budget / tokens[k] for k, w in zip(names, tempered(shares, a)))
    exponent = min(1.0, bisect(high))
    if most_repeats > 1:
        exponent = max(exponent, bisect(lambda a: repeats(a) <= most_repeats))
    found = tempered(shares, exponent)
    if (most := repeats(exponent)) > most_repeats:
        budget *= most_repeats / most
    return dict(zip(names, found)), exponent, budget


def mix(docs: DataFrame, budget: float | None = None, target: float = ENTROPY, most_repeats: float = MOST_REPEATS, block_rows: int = BLOCK_ROWS, seed: int = SEED, most_taken: float = math.inf) -> DataFrame:
    """One row per row of docs: doc_id, source, n_tokens (words), weight, repeats (copies in the mix, 0 or more), block, place.

    A source's quota is its weight of the budget (by default all tokens), but never more than most_taken times what
    it has; what such a source can't fill is left unfilled, and no other source's quota depends on it. It is realised
    as whole passes over the source and a part of one more. A pass is a block permutation: documents are dealt to
    blocks of about block_rows by a keyed hash, blocks are read by number, and block and place say where in a pass a
    document stands. Copy c of a document is in pass c. The part takes the permutation's documents while they fit:
    blocks in order, and of the block where the quota ends, those whose tokens so far still fit. Block totals are a
    table of their own; only one row per source reaches the driver (the number of sources is small, and its
    collection fails loudly beyond maxResultSize). A source with a third of all rows has a third of the blocks.

    The hash is that of id, source and text. Equal rows share it, and are interchangeable; where they are more than a
    block's rows, their places in the table, which must be read from files, spread them. A null source is a source of its
    own, returned as null. Texts without words have no tokens and are taken with every whole pass and with the part while
    it lasts. Null ids are allowed. An empty table gives no rows.
    """
    return _mixed_rows(docs, budget, target, most_repeats, block_rows, seed, most_taken).drop("mark")


def _mixed_rows(docs: DataFrame, budget: float | None, target: float, most_repeats: float, block_rows: int, seed: int, most_taken: float) -> DataFrame:
    rows = pick(docs, doc_id="doc_id:long", source="source:string", text="text:string")
    rows = rows.select("doc_id", "source", words().alias("n_tokens"), text_key("doc_id", "source", "text").alias("mark"))
    rows = frozen(rows.withColumn("key", F.xxhash64(F.lit(seed), "mark")).withColumn("at", F.monotonically_increasing_id()))
    many = frozen(rows.groupBy("key").count().where(F.col("count") > block_rows).select("key", F.lit(True).alias("many")))
    if not many.isEmpty():
        rows = rows.join(if_small(many), "key", "left").withColumn("key", F.when(F.col("many"), F.xxhash64("key", "at")).otherwise(F.col("key"))).drop("many")
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()
    tokens = {_name(r["source"]): r["tokens"] for r in sources}
    total = sum(tokens.values())
    found, _, budget = weights(tokens, float(total if budget is None else budget), target, most_repeats)
    quotas = []
    for r in sources:
        name = _name(r["source"])
        quota = min(found.get(name, 0.0) * budget, most_taken * tokens[name]) if tokens[name] else 0.0
        passes = int(quota // tokens[name] + 1e-9) if tokens[name] else 1
        part = max(0.0, quota - passes * tokens[name]) if tokens[name] else 0.0
        quotas.append((r["source"], found.get(name, 0.0), passes, int(part + 0.5), max(1, -(-r["n"] // block_rows))))
    spark = docs.sparkSession
    known = spark.createDataFrame(quotas, "s string, weight double, passes long, part long, blocks long")
    dealt = rows.join(F.broadcast(known), rows["source"].eqNullSafe(known["s"])).drop("s")
    dealt = dealt.withColumn("block", F.pmod(F.col("key"), F.col("blocks")))
    held = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    before = totals_before(held, "source", "block", "size").select(F.col("source").alias("s"), F.col("block").alias("b"), "before")
    order = Window.partitionBy("source", "block").orderBy("key", "at")
    run = dealt.withColumn("run", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order).cast("long") - 1)
    out = run.join(before, run["source"].eqNullSafe(before["s"]) & (run["block"] == before["b"]))
    extra = (F.col("part") > 0) & (F.col("before") + F.col("run") <= F.col("part"))
    return out.select("doc_id", "source", "n_tokens", "weight", (F.col("passes") + extra.cast("long")).alias("repeats"), "block", "place", "mark")


def _name(source: str | None) -> str:
    return "n" if source is None else f"s{source}"


def mixed(docs: DataFrame, target: float = STAGE_ENTROPY, most_repeats: float = STAGE_REPEATS, budget: float | None = None) -> DataFrame:
    """docs as mix() decides: rows that it leaves out go, rows that it repeats come as often.

    Where nothing may be repeated, the exponent still keeps to MOST_REPEATS, so that a rare source can't pull the
    weights far from the shares, and each source is taken once at most. Only sources whose weight is below their
    share lose documents, however rare the rarest source is. Rows are told apart by id, source and text; rows equal in
    all three come as often together as mix() says.
    """
    limit = most_repeats if most_repeats > 1 else MOST_REPEATS
    rows = _mixed_rows(docs, budget, target, limit, BLOCK_ROWS, SEED, most_repeats)
    plan = rows.groupBy("mark").agg(F.min("repeats").alias("least"), F.max("repeats").alias("most"), F.sum("repeats").alias("total"))
    plan = plan.select(F.col("mark").alias("key"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("copies"), "total")
    return taken(docs, text_key(F.col("doc_id").cast("long"), "source", "text"), frozen(plan))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("weight", F.round("weight", 9))
