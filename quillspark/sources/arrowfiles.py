"""Files that tasks open themselves, block by block, where Spark's readers would put a whole file into one row."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes read at once; a JSON document up to WHOLE bytes is kept as text.
BLOCK, WHOLE = 8 << 20, 64 << 20
SCHEMES = ("file", "hdfs", "viewfs", "s3", "s3a", "s3n", "gs", "gcs")


def opens(path: str) -> bool:
    """Whether tasks can open a path themselves; other stores are left to Spark's readers."""
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", path)
    return scheme is None or scheme[1] in SCHEMES


def place(path: str):
    """(file system, path) as Arrow has them."""
    from pyarrow import fs

    path = re.sub("^s3[an]:", "s3:", re.sub("^file:/*(?=/)", "", path)).rstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def _read(path: str) -> tuple:
    """(size_bytes, sha256, record_count of JSON lines, text of a small JSON document, whether a large one begins and ends as an object or a list)."""
    import codecs

    files, own = place(path)
    digest, decoder = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
    lines, size, records, said = path.endswith(".jsonl"), 0, 0, False
    document, held, first, last = path.endswith(".json"), [], "", ""
    with files.open_input_stream(own) as file:
        while True:
            block = file.read(BLOCK)
            digest.update(block)
            size += len(block)
            if lines or document:
                text = decoder.decode(block, final=not block)
                if lines:
                    # Whether the line that is open has shown a sign is all that goes on to the next block, however long it is.
                    *closed, rest = text.split("\n")
                    for line in closed:
                        records, said = records + (said or bool(line.strip())), False
                    said = said or bool(rest.strip())
                else:
                    first, last = first or text.lstrip()[:1], text.rstrip()[-1:] or last
                    held = [*held, text] if held is not None and size <= WHOLE else None
            if not block:
                break
    kind = {"{}": "object", "[]": "list"}.get(first + last) if document and held is None else None
    return size, digest.hexdigest(), records + said if lines else None, "".join(held) if document and held is not None else None, kind


def contents(paths: DataFrame) -> DataFrame:
    """paths(path) of files that are there -> (path, size_bytes, sha256, record_count, text, kind), a file in blocks of BLOCK bytes, whatever its size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                got = pd.DataFrame([(path, *_read(path))], columns=["path", "size_bytes", "sha256", "record_count", "text", "kind"])
                yield got.astype({"record_count": "Int64"})

    return paths.select("path").mapInPandas(run, "path string, size_bytes long, sha256 string, record_count long, text string, kind string")
