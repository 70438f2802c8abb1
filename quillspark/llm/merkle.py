"""Merkle manifest of a dataset: aligned buckets of leaves in DuckDB, bucket roots and outer proofs in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, frozen, if_small, numbered, pick, split_join

#: Children of a node; levels that one bucket holds (so FAN ** DEPTH leaves); rows that one DuckDB query takes, about.
FAN, DEPTH, ROWS = 8, 3, 1 << 15
#: Memory of one DuckDB engine; ROWS leaves with their runs take some 100 MB.
MEMORY = "512MB"
#: Stands for the node itself between its left and right siblings.
OWN = "@"


def field(value: Column) -> Column:
    """One value as a leaf takes it: a hyphen for null, else its bytes' number, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def _levels(n: Column, fan: int, depth: int) -> Column:
    """How many levels a tree of n leaves has above them, depth at most."""
    out = F.lit(depth)
    for k in reversed(range(depth)):
        out = F.when(n <= fan**k, F.lit(k)).otherwise(out)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = ROWS) -> Iterator[pa.Table]:
    """Sorted rows in tables of at least so many rows that cut no group; a group's first row has `first` set."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            table = pa.Table.from_batches(held)
            starts = np.nonzero(table.column("first").to_numpy())[0]
            cut = int(starts[-1])
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


class Engine:
    """One DuckDB in memory for a task: runs of siblings and digests, level by level, of all buckets of a table at once."""

    def __init__(self, fan: int, depth: int) -> None:
        import duckdb

        self.fan, self.depth = fan, depth
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})

    def climb(self, rows: pa.Table) -> None:
        """rows (g, pos, levels, leaf) -> tables run_k (g, pos, levels, run, h) for each level k, and node_0."""
        self.db.register("given", rows)
        self.db.execute("CREATE OR REPLACE TEMP TABLE node_0 AS SELECT * EXCLUDE (leaf), lower(hex(leaf)) AS h FROM given WHERE leaf IS NOT NULL")
        for k in range(1, self.depth + 1):
            below = "node_0" if k == 1 else f"run_{k - 1}"
            self.db.execute(f"""CREATE OR REPLACE TEMP TABLE run_{k} AS SELECT *, sha256(run) AS h FROM (
                SELECT g, pos // {self.fan} AS pos, levels, string_agg(h, '' ORDER BY pos) AS run
                FROM {below} WHERE levels >= {k} GROUP BY g, pos // {self.fan}, levels)""")

    def roots(self) -> pa.Table:
        """(g, h): what remains of each bucket."""
        parts = [f"SELECT g, h FROM {'run_%d' % k if k else 'node_0'} WHERE levels = {k}" for k in range(self.depth + 1)]
        return self.db.sql(" UNION ALL ".join(parts)).to_arrow_table()

    def proofs(self, outer: pa.Table) -> pa.Table:
        """One row a leaf, from outer (g, path, subroot, root): its proof's digest, and the root folded from the leaf it is given."""
        self.db.register("outer_", outer)
        joins, sides, fold = [], [], "coalesce(lower(hex(n.given_leaf)), n.h)"
        steps = []
        for k in range(1, self.depth + 1):
            place = f"64 * (n.pos // {self.fan ** (k - 1)} % {self.fan})"
            joins.append(f"LEFT JOIN run_{k} r{k} ON r{k}.g = n.g AND r{k}.pos = n.pos // {self.fan**k}")
            sides.append(f"coalesce(left(r{k}.run, {place}) || substr(r{k}.run, {place} + 65), '')")
            steps.append((f"f{k}", f"CASE WHEN r{k}.run IS NULL THEN {{}} ELSE sha256(left(r{k}.run, {place}) || {{}} || substr(r{k}.run, {place} + 65)) END"))
        for _, step in steps:
            fold = step.format(fold, fold) if fold.startswith("coalesce") else step.replace("{}", f"({fold})")
        return self.db.sql(f"""
            WITH folded AS (
                SELECT n.doc_id, n.h AS leaf, o.subroot, o.root, o.path, {" || ".join(sides)} AS inside, {fold} AS top
                FROM node_0 n {" ".join(joins)} JOIN outer_ o ON o.g = n.g)
            SELECT doc_id, leaf, subroot, root, sha256(inside || replace(array_to_string(path, ''), '{OWN}', '')) AS proof_sha256,
                   list_reduce(list_prepend(top, path), lambda a, x: sha256(replace(x, '{OWN}', a))) AS folded_root
            FROM folded""").to_arrow_table()


def outer_paths(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """nodes (tree, at, n, h; n of them in a tree) -> (tree, at, root, path) for each.

    path has one text a level up to the root: the siblings' digests, with OWN where the node itself stands. Each level is
    a grouping of at most `fan` rows, and a join back down with the level above.
    """
    now, levels = nodes.select("tree", "at", "n", "h"), []
    most = now.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = now.where("n > 1").groupBy("tree", "n", F.expr(f"at div {fan}").alias("at"))
        run = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x.h).alias("run")
        runs = up.agg(run).withColumn("h", F.sha2(F.array_join("run", ""), 256)).withColumn("n", F.expr(f"(n + {fan - 1}) div {fan}"))
        levels.append(frozen(runs))
        now, most = levels[-1], -(-most // fan)
    none = F.array().cast("array<string>").alias("path")
    known = None
    for runs in reversed(levels):
        tops = runs.where("n = 1").select("tree", "at", F.col("h").alias("root"), none)
        known = tops if known is None else known.union(tops)
        joined = runs.select("tree", "at", "run").join(known, ["tree", "at"])
        each = joined.select("tree", "at", "root", "path", "run", F.posexplode("run").alias("k", "h"))
        left, right = F.array_join(F.slice("run", F.lit(1), F.col("k")), ""), F.array_join(F.slice("run", F.col("k") + 2, F.lit(fan)), "")
        step = F.array(F.concat(left, F.lit(OWN), right))
        known = each.select("tree", (F.col("at") * fan + F.col("k")).alias("at"), "root", F.concat(step, "path").alias("path"))
    single = nodes.where("n = 1").select("tree", "at", F.col("h").alias("root"), none)
    return single if known is None else known.union(single)


def manifest(leaves: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """leaves (tree string, doc_id long, leaf binary, changed binary) -> one row a leaf: doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified.

    Leaves of a tree are numbered by doc_id (see numbered()) and cut into aligned buckets of fan ** depth. Tasks that hold
    whole buckets build their levels in DuckDB; first for the buckets' roots, which Spark combines to subroots and the
    root, then for the proofs, when each bucket's outer path has joined it as one more row. `changed` is the leaf to
    fold in place of the original; null means the original.

    Ties in doc_id go by the leaf's digest; equal rows are interchangeable. Null ids come first. Null trees are not
    allowed. An empty table gives no rows.
    """
    spark, block = leaves.sparkSession, fan**depth
    rows = numbered(frozen(leaves.select("tree", "doc_id", "leaf", "changed")), "tree", ["doc_id", "leaf"])
    rows = rows.withColumn("bucket", F.expr(f"at div {block}")).withColumn("levels", _levels(F.col("n"), fan, depth))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine(fan, depth)
        for table in whole_groups(batches):
            first = table.column("first").to_numpy()
            g = np.cumsum(first)
            engine.climb(table.select(["pos", "levels", "leaf"]).append_column("g", pa.array(g)))
            found = engine.roots().sort_by("g")
            at = np.nonzero(first)[0]
            yield from table.select(["tree", "bucket", "n"]).take(pa.array(at)).append_column("h", found.column("h")).to_batches()

    whole = rows.select("tree", "bucket", F.col("at").alias("pos"), "n", "levels", "leaf", (F.col("at") % block == 0).alias("first"))
    whole = whole.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "pos")
    buckets = frozen(whole.mapInArrow(roots, "tree string, bucket long, n long, h string"))
    nodes = buckets.select("tree", F.col("bucket").alias("at"), F.expr(f"(n + {block - 1}) div {block}").alias("n"), "h")
    inner = frozen(outer_paths(nodes, fan))
    trees = inner.where("at = 0").select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("root").alias("h"))
    tops = numbered(frozen(trees), "all", ["name"]).select(F.col("all").alias("tree"), "at", "n", "h", "name")
    above = outer_paths(tops, fan).select("at", F.col("root").alias("top"), F.col("path").alias("rest"))
    above = frozen(tops.select("at", F.col("name").alias("tree")).join(above, "at").drop("at"))
    small = if_small(above)
    paths = inner.join(small, "tree") if small is not above else split_join(inner, above, ["tree"], "inner")
    paths = paths.select("tree", F.col("at").alias("bucket"), F.concat("path", "rest").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root"))

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine(fan, depth)
        for table in whole_groups(batches):
            first = table.column("first").to_numpy()
            table = table.append_column("g", pa.array(np.cumsum(first)))
            engine.climb(table.select(["g", "pos", "levels", "leaf", "doc_id", "given_leaf"]))
            yield from engine.proofs(table.filter(pa.array(first)).select(["g", "path", "subroot", "root"])).to_batches(max_chunksize=4096)

    rows = rows.withColumnRenamed("at", "pos")
    columns = ["tree", "bucket", "first", "pos", "levels", "doc_id", "leaf", "given_leaf", "path", "subroot", "root"]
    heads = paths.withColumn("first", F.lit(True)).select(*[F.col(c) if c in ("tree", "bucket", "first", "path", "subroot", "root") else F.lit(None).alias(c) for c in columns])
    body = rows.withColumn("given_leaf", F.col("changed")).withColumn("first", F.lit(False)).select(*[F.col(c) if c in rows.columns or c in ("first", "given_leaf") else F.lit(None).alias(c) for c in columns])
    both = body.unionByName(heads).repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "pos")
    out = both.mapInArrow(proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """documents -> leaves for manifest(), a tree a language: the row's digest, and that of the row as tampered with.

    Where 3 divides the crc32 of the id, A-Z of the text are lower-cased for `changed`; a null text or id stays, and
    `changed` is null where nothing differs. Other columns than the five of the contract take no part.
    """
    docs = pick(docs, doc_id="doc_id:long", source="source", lang="lang", n_chars="n_chars:long", text="text")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", upper, upper.lower())
    changed = F.when((crc_remainder("doc_id", 3) == 0) & (lowered != F.col("text")), leaf(*head, lowered))
    tree = F.coalesce(F.concat(F.lit(":"), F.col("lang")), F.lit("-"))  # null first, bytewise
    return docs.select(tree.alias("tree"), "doc_id", leaf(*head, F.col("text")).alias("leaf"), changed.alias("changed"))


#: The same rows in DuckDB's SQL: levels of each language by recursion, then those over the languages.
ORACLE = """
WITH RECURSIVE src AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce(':' || lang, '-') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM src
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), level(tree, k, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, k + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM level WHERE n > 1 GROUP BY tree, k, n, pos // 8
), tops AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM level WHERE n = 1
), upper_(k, pos, n, h) AS (
  SELECT 0, pos, n, h FROM tops
  UNION ALL
  SELECT k + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_ WHERE n > 1 GROUP BY k, n, pos // 8
), sides AS (
  SELECT p.tree, p.pos, l.k, coalesce(string_agg(l.h, '' ORDER BY l.pos) FILTER (l.pos < p.pos >> (3 * l.k)), '') AS a,
         coalesce(string_agg(l.h, '' ORDER BY l.pos) FILTER (l.pos > p.pos >> (3 * l.k)), '') AS z
  FROM placed p JOIN level l ON l.tree = p.tree AND l.n > 1 AND l.pos // 8 = p.pos >> (3 * l.k + 3) GROUP BY p.tree, p.pos, l.k
), above AS (
  SELECT t.tree, u.k, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < t.pos >> (3 * u.k)), '') AS a,
         coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > t.pos >> (3 * u.k)), '') AS z
  FROM tops t JOIN upper_ u ON u.n > 1 AND u.pos // 8 = t.pos >> (3 * u.k + 3) GROUP BY t.tree, u.k
), inside AS (SELECT tree, pos, list({a: a, z: z} ORDER BY k) AS path FROM sides GROUP BY tree, pos),
outside AS (SELECT tree, list({a: a, z: z} ORDER BY k) AS path FROM above GROUP BY tree),
proofs AS (
  SELECT p.doc_id, p.leaf, coalesce(p.changed, p.leaf) AS given, t.h AS subroot, (SELECT h FROM upper_ WHERE n = 1) AS root,
         list_concat(coalesce(i.path, []), coalesce(o.path, [])) AS path
  FROM placed p JOIN tops t USING (tree) LEFT JOIN inside i ON i.tree = p.tree AND i.pos = p.pos LEFT JOIN outside o ON o.tree = p.tree
), folded AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda s: s.a || s.z), '')) AS proof_sha256,
    list_reduce(list_prepend({a: given, z: ''}, path), lambda x, s: {a: sha256(s.a || x.a || s.z), z: ''}).a AS folded_root
  FROM proofs
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(document_leaves(spark.read.parquet(f"{sf_dir}/documents.parquet")))

