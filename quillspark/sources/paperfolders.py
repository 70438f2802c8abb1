"""Papers in folders of their own as a Spark data source: paper.json, chunks.jsonl, equations.json and sections.json below processed/papers."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .arrowfiles import place

#: Partitions at most; folders are dealt among them.
PARTS = 1024
# The files of a paper, its fields, and the statuses of papers whose parts belong to a dataset.
FILES = {"chunks": "chunks.jsonl", "equations": "equations.json", "sections": "sections.json"}
TEXTS = ["paper_id", "arxiv_id", "title", "abstract", "parsing_status", "source_type"]
COUNTS = ["sections_count", "equations_count", "chunks_count", "plain_text_word_count"]
INCLUDED = ["success", "partial"]

SCHEMAS = {
    "papers": "folder string, " + ", ".join(f"{f} string" for f in TEXTS) + ", " + ", ".join(f"{f} long" for f in COUNTS) + ", paper_dir string, files map<string,string>",
    **{kind: "folder string, paper_id string, pos long, source_file string, record string" for kind in FILES},
}
WRITTEN = "folder string, paper string, chunks array<string>, equations array<string>, sections array<string>"


def _there(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type != fs.FileType.NotFound


def _objects(said: object, where: str) -> dict:
    if not isinstance(said, dict):
        raise ValueError(f"{where}: not a JSON object")
    return said


class Folders(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class Reader(DataSourceReader):
    def __init__(self, root: str, kind: str):
        self.root, self.kind, self.only = root.rstrip("/"), kind, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A folder asked for by name is the only one that is looked at; other filters are left to Spark."""
        for one in filters:
            if isinstance(one, EqualTo | In) and one.attribute == ("folder",):
                named = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.only = named if self.only is None else self.only & named
            else:
                yield one

    def partitions(self) -> list[Folders]:
        from pyarrow import fs

        files, base = place(f"{self.root}/processed/papers")
        if not _there(files, base):
            raise FileNotFoundError(f"no folder of papers: {base}")
        if self.only is None:
            names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory)
        else:
            plain = [n for n in sorted(self.only) if n and "/" not in n and n not in (".", "..")]
            names = [i.base_name for i in files.get_file_info([f"{base}/{n}" for n in plain]) if i.type == fs.FileType.Directory]
        size = max(1, -(-len(names) // PARTS))
        return [Folders(names[n : n + size]) for n in range(0, len(names), size)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        files, base = place(f"{self.root}/processed/papers")
        for name in partition.names:
            folder = f"{base}/{name}"
            if not _there(files, f"{folder}/paper.json"):
                raise FileNotFoundError(f"missing paper.json: {folder}/paper.json")
            with files.open_input_stream(f"{folder}/paper.json") as file:
                paper = _objects(json.loads(file.read()), f"{folder}/paper.json")
            ident = str(paper.get("paper_id", name))
            declared = paper.get("files") or {}
            if self.kind == "papers":
                texts = [ident, *[str(paper.get(f) or "") for f in TEXTS[1:]]]
                yield (name, *texts, *[int(paper.get(f) or 0) for f in COUNTS], folder, {str(k): str(v) for k, v in declared.items() if v is not None})
            elif paper.get("parsing_status") in INCLUDED:
                # A file that paper.json names is taken if it is there, else the one of the usual name beside it.
                named = declared.get(self.kind)
                path = next((p for p in (named, f"{folder}/{FILES[self.kind]}") if p and _there(files, p)), None)
                for pos, record in self.records(files, path) if path else ():
                    yield (name, ident, pos, path, json.dumps(record, sort_keys=True, ensure_ascii=False))

    def records(self, files, path: str) -> Iterator[tuple[int, dict]]:
        """Lines are read one by one; a list is one document."""
        import io

        with files.open_input_stream(path) as file:
            if path.endswith(".jsonl"):
                for number, line in enumerate(io.TextIOWrapper(file, "utf-8", newline="\n"), 1):
                    if line.strip():
                        yield number, _objects(json.loads(line), f"{path}:{number}")
            else:
                said = json.loads(file.read())
                if not isinstance(said, list):
                    raise ValueError(f"{path}: not a JSON list")
                for number, one in enumerate(said, 1):
                    yield number, _objects(one, f"{path}, item {number}")


class Written(WriterCommitMessage):
    def __init__(self, papers: int):
        self.papers = papers


class Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        """A folder a row. Each file is put in its place whole, paper.json last, so a task that is run again leaves the same files."""
        papers = 0
        for row in iterator:
            files, base = place(f"{self.root}/processed/papers")
            if not row["folder"] or "/" in row["folder"] or row["folder"].startswith("."):
                raise ValueError(f"no name of a folder: {row['folder']!r}")
            folder = f"{base}/{row['folder']}"
            files.create_dir(folder, recursive=True)
            for kind in ("equations", "sections"):
                self.put(files, f"{folder}/{FILES[kind]}", json.dumps([json.loads(r) for r in row[kind] or []], indent=2, sort_keys=True, ensure_ascii=False) + "\n")
            self.put(files, f"{folder}/{FILES['chunks']}", "".join(json.dumps(json.loads(r), sort_keys=True, ensure_ascii=False) + "\n" for r in row["chunks"] or []))
            self.put(files, f"{folder}/paper.json", json.dumps(json.loads(row["paper"]), indent=2, sort_keys=True, ensure_ascii=False) + "\n")
            papers += 1
        return Written(papers)

    def put(self, files, path: str, text: str) -> None:
        import uuid

        head, _, name = path.rpartition("/")
        draft = f"{head}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(text.encode())
        files.move(draft, path)


class PaperFolders(DataSource):
    """Options: path, and kind (papers, chunks, equations, sections) to read."""

    @classmethod
    def name(cls) -> str:
        return "paper_folders"

    def kind(self) -> str:
        kind = self.options.get("kind", "papers")
        if kind not in SCHEMAS:
            raise ValueError(f"kind is one of {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self.kind()]

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.kind())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Names the source in this session and lets filters reach sources written in Python."""
    spark.dataSource.register(PaperFolders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, root: str, kind: str = "papers") -> DataFrame:
    """papers, or the parts of those that were parsed: (folder, paper_id, pos, source_file, record as JSON). A filter on folder opens those folders alone.

    A folder without paper.json, a line or item that is no object, and a root without papers are errors that name the place; a paper without
    a file of the kind has no parts.
    """
    register(spark)
    return spark.read.format("paper_folders").option("kind", kind).load(root)


def write(tables: dict[str, DataFrame], root: str) -> str:
    """papers(paper_id, ...), and chunks, equations, sections (paper_id, ...) in order of pos or else of all fields -> a folder a paper, named by its id.

    A paper's parts meet in one row, as they do in its folder; what belongs to no paper is left out.
    """
    papers = tables["papers"]
    register(papers.sparkSession)
    rows = papers.select("paper_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("paper"))
    for kind in FILES:
        if kind not in tables:
            rows = rows.withColumn(kind, F.array().cast("array<string>"))
            continue
        own = tables[kind]
        order = [c for c in ("pos", "chunk_no") if c in own.columns]
        body = F.to_json(F.struct(*[c for c in own.columns if c != "paper_id"]), {"ignoreNullFields": "false"})
        parts = own.select("paper_id", F.struct(*order, body.alias("body")).alias("part")).groupBy("paper_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
        rows = rows.join(parts, "paper_id", "left").withColumn(kind, F.coalesce(F.col("parts.body"), F.array().cast("array<string>"))).drop("parts")
    out = rows.select(F.col("paper_id").alias("folder"), "paper", *FILES)
    out.write.format("paper_folders").mode("append").save(root)
    return root
