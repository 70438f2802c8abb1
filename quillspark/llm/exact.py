"""Exact duplicates by an extendible-hash index (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, frozen, if_small, pick

#: The directory never has more than 2 to this power entries, so it can be broadcast at any input size.
MAX_DEPTH = 14
#: Entries that a bucket may hold before it is split, at least; and the share of all entries that sets it above that.
MIN_CAPACITY, BUCKETS = 16, 2 ** (MAX_DEPTH - 1)
#: Rows of one hash that one task holds, at most: their ids form one list.
MOST_ROWS = 1 << 20


def _norm(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def normalised(column: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return _norm(F.col(column))


def directory(leaves: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int]]:
    """Doubling: entry -> bucket, for every entry of the directory at its final depth.

    leaves has the number of keys under each prefix of max_depth bits. The directory begins with one entry. While
    a bucket is overfull and can be split, the directory doubles if that bucket is as deep as it is, and the bucket
    becomes two of one more bit. A bucket is named by its bits behind a leading one.
    """
    counts: dict[int, int] = {}
    for leaf, n in leaves.items():
        name = leaf | 1 << max_depth
        while name:
            counts[name] = counts.get(name, 0) + n
            name >>= 1
    depth, open_, buckets = 0, [1], []
    while open_:
        name = open_.pop()
        local = name.bit_length() - 1
        if counts.get(name, 0) > capacity and local < max_depth:
            depth = max(depth, local + 1)
            open_ += [2 * name, 2 * name + 1]
        else:
            buckets.append((name, local))
    entries = []
    for name, local in buckets:
        free = depth - local
        first = (name - (1 << local)) << free
        entries += [(depth, entry, name) for entry in range(first, first + (1 << free))]
    return sorted(entries)


def owners(rows: DataFrame, capacity: int | None = None) -> DataFrame:
    """rows (doc_id, h, ...) with the bucket and page whose task owns them, and pages, the number of their hash's pages.

    The index on shared files holds how often each 64-bit hash occurs. From it the directory is doubled until no bucket
    of several hashes is overfull, and a row's bucket is where the first bits of its hash lead. Where one hash alone
    overfills a bucket, its rows get overflow pages, which different tasks own; the page follows from the id and
    the row's place in the table (which must be read from files), so rows without an id, or with one id, spread as
    well. Capacity follows the number of rows up to MOST_ROWS. The directory is bounded, and hashes with pages are
    at most one in a capacity of rows.
    """
    index = frozen(rows.groupBy("h").agg(F.count("*").alias("n")))
    total = index.agg(F.sum("n")).first()[0] or 0
    capacity = capacity or min(MOST_ROWS, max(MIN_CAPACITY, -(-total // BUCKETS)))
    leaf = F.shiftrightunsigned(F.col("h"), 64 - MAX_DEPTH)
    leaves = index.groupBy(leaf.alias("leaf")).agg(F.sum(F.least("n", F.lit(capacity))).alias("n"))
    entries = directory({r["leaf"]: r["n"] for r in leaves.collect()}, capacity)
    depth = entries[0][0]
    known = rows.sparkSession.createDataFrame([(e, b) for _, e, b in entries], "entry long, bucket long")
    hot = index.where(F.col("n") > capacity).select("h", F.ceil(F.col("n") / capacity).cast("int").alias("pages"))
    entry = F.shiftrightunsigned(F.col("h"), 64 - depth) if depth else F.lit(0).cast("long")
    out = rows.withColumn("entry", entry).withColumn("place", F.monotonically_increasing_id())
    out = out.join(F.broadcast(known), "entry").join(if_small(hot), "h", "left").withColumn("pages", F.coalesce("pages", F.lit(1)))
    return out.withColumn("page", F.pmod(F.xxhash64(F.lit("page"), "doc_id", "place"), "pages")).drop("entry", "place")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts go to the task that owns their bucket (see owners()), where rows of one hash form a chain: they are told
    apart by comparing their bytes, so colliding texts are different groups. A group of one page leaves its task
    decided. A group that overfills its bucket leaves each page with the ids it holds there and the text once; pages
    are merged by comparing the bytes again, and their ids follow. The digest is returned, but decides nothing.

    Null texts count as empty; empty texts are copies of each other. The smallest doc_id of a group stays. Repeated
    rows with one doc_id are counted in group_size and kept or dropped together; with a null doc_id a row is not
    kept unless nothing else decides (keep_id is null where all ids are). An empty table gives no rows.
    """
    rows = pick(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")
    rows = owners(rows.select("doc_id", normalised().alias("norm")).withColumn("h", F.xxhash64("norm")), capacity).repartition("bucket", "page")
    chains = rows.groupBy("bucket", "page", "pages", "h", "norm").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.collect_list(F.struct("doc_id")).alias("ids"))
    part = F.when(F.col("pages") > 1, F.col("norm")).alias("norm")
    chains = frozen(chains.select("h", "low", "n", "ids", F.lower(F.sha2("norm", 256)).alias("text_sha256"), part))
    single, paged = chains.where("norm IS NULL").select("low", "n", "ids", "text_sha256"), chains.where("norm IS NOT NULL")
    merged = paged.groupBy("h", "norm").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    paged = paged.drop("low", "n").join(merged, ["h", "norm"]).select("low", "n", "ids", "text_sha256")
    out = single.union(paged).select("low", "n", "text_sha256", F.explode("ids").alias("id"))
    kept = F.coalesce(F.col("id.doc_id") == F.col("low"), F.lit(False))
    return out.select("id.doc_id", F.col("low").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts: that with the smallest doc_id, rows without an id last.

    Rows themselves go to the owner of their bucket, which compares texts and lets one pass. Rows whose text overfills
    a bucket are first combined in the tasks that read them. Of rows that share the id as well, that with the smallest
    text stays, of equal ones any.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    ident, text = F.col(f"row.c{names.index('doc_id')}").cast("long"), F.col(f"row.c{names.index('text')}").cast("string")
    rows = plain.select(F.struct("*").alias("row"))
    rows = owners(rows.withColumn("doc_id", ident).withColumn("h", F.xxhash64(_norm(text)))).drop("doc_id")
    first = F.min_by("row", F.struct(ident.isNull(), ident, text)).alias("row")
    cold = rows.where("pages = 1").repartition("bucket", "page").withColumn("norm", _norm(text)).groupBy("bucket", "page", "h", "norm").agg(first)
    hot = rows.where("pages > 1").withColumn("norm", _norm(text)).groupBy("h", "norm").agg(first)
    return cold.select("row.*").union(hot.select("row.*")).toDF(*names)


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
