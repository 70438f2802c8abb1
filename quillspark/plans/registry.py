"""Queries by name and the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, artifacts, corpus, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = retrieval.QUERIES | corpus.QUERIES | answers.QUERIES | artifacts.QUERIES
ORACLES: dict[str, str] = retrieval.ORACLES | corpus.ORACLES | answers.ORACLES | artifacts.ORACLES
