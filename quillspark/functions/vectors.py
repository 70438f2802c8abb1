"""Column functions over vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Over the length of the shorter vector."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = norm(vector)
    return F.when(size == 0, vector.cast("array<double>")).otherwise(F.transform(vector, lambda x: x.cast("double") / size))


def cosine(left: Column, right: Column) -> Column:
    sizes = norm(left) * norm(right)
    return F.when(sizes == 0, F.lit(0.0)).otherwise(dot(left, right) / sizes)


def md5_slot(token: Column, dimension: int) -> tuple[Column, Column]:
    """(index, sign) of a token by md5, a family that other engines have too."""
    h = F.conv(F.substring(F.md5(token.cast("binary")), 1, 15), 16, 10).cast("long")
    return h % dimension, F.when(h % (2 * dimension) < dimension, 1.0).otherwise(-1.0)


def blake_slot(dimension: int, model: str):
    """A vectorised function token -> (index, sign) by an unsigned 64-bit BLAKE2 digest salted with the model's name.

    Applied to distinct tokens only, so its cost follows the vocabulary.
    """

    @F.pandas_udf("struct<i:long,sign:double>")
    def slot(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for tokens in batches:
            raw = [int.from_bytes(hashlib.blake2b(f"{model}\0{t}".encode(), digest_size=8).digest(), "big") for t in tokens]
            yield pd.DataFrame({"i": [r % dimension for r in raw], "sign": [1.0 if r >> 63 == 0 else -1.0 for r in raw]})

    return slot
