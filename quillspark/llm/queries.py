"""The queries of this subpackage, by name, and those of them that DuckDB's SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embeddings, exact, langid, merkle, mixing, negatives, packing, pii, quality, simhash, substring, tokencount

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        exact.op1_exact_dedup, simhash.op2_simhash, tokencount.op3_token_counts, langid.op4_langid, packing.op5_packing,
        mixing.op6_mixing, substring.op7_substring, quality.op8_quality, pii.op9_pii, embeddings.op10_embeddings,
        merkle.op11_merkle_manifest, negatives.op12_hard_negatives, chat.op13_chat_format,
    )
}

ORACLES: dict[str, str] = {"op1_exact_dedup": exact.ORACLE, "op7_substring": substring.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_chat_format": chat.ORACLE}
