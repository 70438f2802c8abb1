"""Readers: JSON lines, JSON documents, id lists, Atom feeds, archives of sources, dataset folders."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

METADATA = "arxiv_id string, title string, authors array<string>, abstract string, categories array<string>, published string, url string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of each line of text files, numbered from 1 as they stand in their file.

    Files are split by Spark's reader at any size. Lines are numbered within their split; a small table of how many
    lines the splits before hold does the rest.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = splits.select(F.col("file").alias("f"), F.col("start").alias("s"), "first", before.alias("before"))
    out = rows.join(told, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    return out.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def jsonl(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """(file, line, record variant, bad boolean) of each line that isn't blank.

    Lines are numbered as they stand in their file. Without permissive, a line that is no JSON object ends the
    query with an error that names it; with it, such lines are marked and keep their text.
    """
    rows = numbered_lines(spark, path).where(~T.blank(F.col("text"))).withColumn("record", F.try_parse_json("text"))
    rows = rows.withColumn("bad", ~F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False)))
    if permissive:
        return rows
    message = F.format_string("%s, line %d: not a JSON object", "file", "line")
    return rows.withColumn("record", F.when(F.col("bad"), F.raise_error(message).cast("variant")).otherwise(F.col("record"))).drop("text", "bad")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema, split by Spark's reader at any size; a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, kind: str = "OBJECT") -> DataFrame:
    """(file, record variant) of small JSON files, one document each; one that can't be parsed or is of another kind (OBJECT, ARRAY) ends the query."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    record = F.try_parse_json("text")
    wrong = F.when(record.isNull(), "invalid JSON").when(~F.schema_of_variant(record).startswith(kind), f"no JSON {kind.lower()}")
    return rows.select("file", F.when(wrong.isNotNull(), F.raise_error(F.concat("file", F.lit(": "), wrong)).cast("variant")).otherwise(record).alias("record"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A file with a list of metadata records, or with one."""
    return spark.read.schema(METADATA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def metadata_records(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """(file, index, METADATA fields) of a JSON list of metadata records, or of one object; each obeys records.metadata_error().

    An empty list, a list in place of one object or the reverse, and the first record that breaks a rule, named by its
    index from 1, end the query with an error.
    """
    from ..operators import records

    if single:
        rows = json_document(spark, path).select("file", F.lit(1).alias("index"), "record")
    else:
        each = json_document(spark, path, "ARRAY").withColumn("items", F.try_variant_get("record", "$", "array<variant>"))
        each = each.withColumn("items", F.when(F.size("items") == 0, F.raise_error(F.concat("file", F.lit(": no record in the list"))).cast("array<variant>")).otherwise(F.col("items")))
        rows = each.select("file", F.posexplode("items").alias("index", "record")).withColumn("index", F.col("index") + 1)
    error = F.coalesce(F.when(~F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False)), "no object"), records.metadata_error(F.col("record")))
    rows = rows.withColumn("record", F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("record "), F.col("index").cast("string"), F.lit(": "), error)).cast("variant")).otherwise(F.col("record")))
    fields = [F.try_variant_get("record", f"$.{f}", "array<string>" if f in records.LISTS else "string").alias(f) for f in records.METADATA]
    return rows.select("file", F.col("index").cast("long").alias("index"), *fields)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of a text file: blank lines and comments left out, order and repeats kept; a list without ids is an error."""
    rows = numbered_lines(spark, path).select((F.col("line") - 1).alias("pos"), T.trim(F.substring_index("text", "#", 1)).alias("id")).where("id <> ''")
    if rows.isEmpty():
        raise ValueError(f"no identifier in {path}")
    return rows


def require(spark: SparkSession, *paths: str) -> None:
    """All paths, files or folders, are there, or the error names every one that isn't."""

    def there(path: str) -> bool:
        try:
            spark.read.format("binaryFile").load(path)
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return False
            raise
        return True

    lacking = [path for path in paths if not there(path)]
    if lacking:
        raise FileNotFoundError("not there: " + ", ".join(lacking))


def dataset_tables(spark: SparkSession, files: dict[str, str]) -> dict[str, DataFrame]:
    """name -> path of JSON lines, a file or a folder of them -> name -> its lines; all paths must be there."""
    require(spark, *files.values())
    return {name: jsonl(spark, path) for name, path in files.items()}


def query_address(query: str | None = None, identifier: str | None = None, most: int = 1) -> str:
    """The address that a feed of metadata comes from, for one identifier or one search, newest first."""
    from urllib.parse import urlencode

    if most < 1 or bool(query and query.strip()) == bool(identifier and identifier.strip()):
        raise ValueError("a search or an identifier, and one result at least")
    if identifier:
        asked = {"id_list": identifier.strip().removeprefix("arXiv:").removeprefix("arxiv:").rsplit("/abs/")[-1].rsplit("/pdf/")[-1].removesuffix(".pdf").strip("/")}
    else:
        asked = {"search_query": query.strip(), "sortBy": "submittedDate", "sortOrder": "descending"}
    return "https://export.arxiv.org/api/query?" + urlencode({"start": 0, "max_results": most} | asked)


def atom(feeds: DataFrame) -> DataFrame:
    """feeds(xml) -> one row per entry: identifier, title, abstract, authors, categories, published, url; a feed without entries is an error."""
    none = ~F.coalesce(F.col("xml").rlike(r"(?s)<(?:\w+:)?entry\b.*?</(?:\w+:)?entry>"), F.lit(False))
    feeds = feeds.select(F.when(none, F.raise_error("a feed without entries").cast("string")).otherwise(F.col("xml")).alias("xml"))
    plain = F.regexp_replace(F.regexp_replace("xml", r'\sxmlns(?::\w+)?="[^"]*"', ""), r"(</?)\w+:", "$1")
    entries = feeds.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))).alias("e"))
    one = lambda p: T.ws(F.xpath_string("e", F.lit(p)))
    many = lambda p: F.filter(F.transform(F.xpath("e", F.lit(p)), T.ws), lambda x: x != "")
    out = entries.select(T.paper_key(one("/entry/id")).alias("arxiv_id"), one("/entry/title").alias("title"), many("/entry/author/name/text()").alias("authors"), one("/entry/summary").alias("abstract"), many("/entry/category/@term").alias("categories"), one("/entry/published").alias("published"))
    return out.withColumn("url", F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id")).where("title <> '' AND abstract <> ''")


def sniff(blobs: DataFrame) -> DataFrame:
    """blobs(paper_id, content) -> (paper_id, path, text, status, error): what a downloaded source holds.

    Archives with TeX files give a row per text file, never outside their folder; a lone compressed or plain
    file gives one. PDF, pages that say the source is missing, and anything else give a row with a status only.
    """

    def decode(data: bytes) -> str:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("latin-1")

    def latex(text: str) -> bool:
        return "\\documentclass" in text or "\\begin{document}" in text

    def files(data: bytes) -> list[tuple]:
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as archive:
                members = [m for m in archive.getmembers() if m.isfile()]
                if any(m.name.startswith("/") or ".." in m.name.split("/") for m in members):
                    return [(None, None, "error", "archive_extract_error")]
                read = [(m.name, decode(archive.extractfile(m).read())) for m in members if m.name.lower().endswith((".tex", ".bib", ".sty", ".bbl"))]
                if any(name.lower().endswith(".tex") for name, _ in read):
                    return [(name, text, "latex_source", None) for name, text in read]
        except (tarfile.TarError, OSError, EOFError, zlib.error):
            pass
        if data.lstrip().startswith(b"%PDF"):
            return [(None, None, "unavailable", "pdf_fallback_skipped")]
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error):
            pass
        if data.lstrip().startswith(b"%PDF"):
            return [(None, None, "unavailable", "pdf_fallback_skipped")]
        text = decode(data)
        if latex(text):
            return [("main.tex", text, "latex_source", None)]
        if "<html" in text[:2000].lower() or "not found" in text[:2000].lower():
            return [(None, None, "unavailable", "source_unavailable")]
        return [(None, None, "error", "archive_extract_error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *f) for p, c in zip(batch["paper_id"], batch["content"]) for f in files(bytes(c))]
            yield pd.DataFrame(rows, columns=["paper_id", "path", "text", "status", "error"])

    return blobs.select("paper_id", "content").mapInPandas(run, "paper_id string, path string, text string, status string, error string")


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """The paper.json of each folder below processed/papers; paper_id defaults to the folder's name."""
    schema = "paper_id string, arxiv_id string, title string, abstract string, parsing_status string, source_type string, sections_count long, equations_count long, chunks_count long, plain_text_word_count long"
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/processed/papers/*/paper.json").select("*", "_metadata.file_path")
    name = F.element_at(F.split("file_path", "/"), -2)
    filled = [F.coalesce(c, F.lit("") if kind == "string" else F.lit(0)).alias(c) for c, kind in rows.dtypes if c not in ("paper_id", "file_path")]
    return rows.select(F.coalesce("paper_id", name).alias("paper_id"), *filled, F.regexp_replace("file_path", "/paper.json$", "").alias("paper_dir"))
