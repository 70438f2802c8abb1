"""What the operators of this subpackage share: tables, checkpoints, joins on skewed keys, words."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, as a character class and as bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Python's bytes.split() without arguments splits on exactly these bytes.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Rows in one Arrow batch: a batch of long texts must fit a worker's memory.
ARROW_ROWS = 400
#: Bytes of text that a task's Python side works on at once.
BATCH_BYTES = 16 << 20
#: Blocks whose sizes one window adds up.
SPAN = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are sent to Python workers in small Arrow batches, whatever the session's default is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only a session on one machine may make its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def frozen(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: lost executors cost nothing, and the plan starts anew."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns as new_name="old_name:type", so that others' names can't clash."""
    out = []
    for new, spec in columns.items():
        old, _, kind = spec.partition(":")
        out.append(F.col(f"`{old}`").cast(kind or "string").alias(new))
    return df.select(*out)


def if_small(table: DataFrame, most: int = 1 << 20) -> DataFrame:
    """table, to be sent to every task if it has at most so many rows; else as it is, for Spark to decide."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def split_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """An equi-join on a key that a third of the left rows may share.

    A second key, derived from the first, keeps Spark from reusing the partitioning that an aggregate has left
    on one side. Both sides are then exchanged for the join alone, and adaptive execution can split the hot key.
    """
    salt = F.xxhash64(*on)
    joined = left.withColumn("__k", salt).join(right.withColumn("__k", salt), [*on, "__k"], how)
    return joined.drop("__k")


def totals_before(sizes: DataFrame, group: str, at: str, size: str, span: int = SPAN) -> DataFrame:
    """sizes (group, at, size; each pair once) -> (group, at, before): the group's total below each at.

    Runs of span values of at are added up first, so a window orders span rows, or one row for each run: of a group
    in blocks of a thousand rows, a millionth.
    """
    from pyspark.sql import Window

    cut = sizes.withColumn("__run", F.floor(F.col(at) / span).cast("long"))
    runs = cut.groupBy(group, "__run").agg(F.sum(size).alias("__size"))
    lower = F.sum("__size").over(Window.partitionBy(group).orderBy("__run")) - F.col("__size")
    runs = runs.select(F.col(group).alias("__group"), F.col("__run").alias("__at"), lower.alias("__lower"))
    own = cut.withColumn("__own", F.sum(size).over(Window.partitionBy(group, "__run").orderBy(at)) - F.col(size))
    joined = own.join(runs, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__run") == F.col("__at")))
    return joined.select(group, at, (F.col("__own") + F.col("__lower")).alias("before"))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with at (0, 1, ... within the group, by order) and n (the group's rows); equal rows in any order, nulls first.

    One exchange by ranges of (group, order), so a group of any size is spread. Rows are written in that order with their
    numbers within a partition; how many rows each partition holds of each group then gives the rest. Ranges come
    from a sample of the input, which is read twice: hand over a frozen one if it is dear.
    """
    from pyspark.sql import Window

    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = frozen(placed.select("*", F.monotonically_increasing_id().alias("__mid"))).withColumn("__piece", F.shiftright("__mid", 33))
    pieces = placed.groupBy(group, "__piece").agg(F.min("__mid").alias("__first"), F.count("*").alias("__rows"))
    own = Window.partitionBy(group)
    before = (F.sum("__rows").over(own.orderBy("__piece")) - F.col("__rows")).alias("__before")
    pieces = pieces.select(F.col(group).alias("__group"), F.col("__piece").alias("__p"), "__first", before, F.sum("__rows").over(own).alias("n"))
    joined = placed.join(if_small(pieces), (F.col("__piece") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__group")))
    at = (F.col("__before") + F.col("__mid") - F.col("__first")).alias("at")
    return joined.select(*rows.columns, at, "n")


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, by: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """About per_class rows of each class, those with the smallest hashes of their key, or all of a smaller class; classes are few.

    A count of each class says below which hash they lie; the number taken differs from per_class by chance, by its
    root. Rows with one key are taken together: the caller combines them.
    """
    span = 1 << 40
    hashed = df.withColumn("__h", F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(span)))
    sizes = df.groupBy(by).agg(F.count("*").alias("__n"))
    low = hashed.join(F.broadcast(sizes), by).where(F.col("__h").cast("double") * F.col("__n") < F.lit(float(span) * per_class))
    return low.drop("__h", "__n")


def lower_ascii(data: bytes) -> bytes:
    """Lower-cases A-Z alone."""
    return data.translate(_LOWER)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a letter (Unicode category L) is in the text; numbers and signs that look like letters are none."""
    return bool(text) and any(map(str.isalpha, text))


def by_bytes(batches: Iterator, column: str, most: int = BATCH_BYTES) -> Iterator:
    """The same rows in batches of at most so many bytes of the column, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += size
        if at < batch.num_rows:
            yield batch.slice(at)


def text_key(*columns: str | Column) -> Column:
    """A number for each row's values in these columns; equal rows have equal ones."""
    return F.xxhash64(*[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00null")) for c in columns])


def taken(docs: DataFrame, key: Column, plan: DataFrame) -> DataFrame:
    """docs as often as plan(key, copies, total) says: a row whose key is not in it goes.

    Rows that share a key are equal in what the plan looks at. With copies, each comes so often; where copies is null,
    one of them comes total times: such rows are first combined in the tasks that read them, so that no task
    receives them all.
    """
    names = docs.columns
    plain = docs.withColumn("__key", key).toDF(*[f"c{k}" for k in range(len(names))], "__key")
    own = [f"c{k}" for k in range(len(names))]
    plan = plan.select(F.col("key").alias("__key"), F.col("copies").alias("__copies"), F.col("total").alias("__total"))
    each = plain.join(plan.where("__copies > 0").drop("__total"), "__key")
    out = each.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select(*own)
    apart = plan.where("__copies IS NULL AND __total > 0").drop("__copies")
    if not apart.isEmpty():
        one = plain.join(apart.select("__key"), "__key", "left_semi").groupBy("__key").agg(F.first(F.struct(*own)).alias("__row"))
        one = one.join(apart, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__total"))))
        out = out.union(one.select(*[F.col(f"__row.{c}").alias(c) for c in own]))
    return out.toDF(*names)


def forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges (node, smallest node) that join the same nodes as the pairs do; for one task's share only."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root) for x in list(parent) if (root := find(x)) != x]
