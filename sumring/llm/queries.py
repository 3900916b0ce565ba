"""The ten corpus operators as queries on the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import jaccard_join, line_dedup, lm, minhash, mixing, piece_fst, pivots, quality, token_store, warc

_MODULES = {
    "op1_lm_scoring": lm,
    "op2_line_dedup": line_dedup,
    "op3_embedding_near_dedup": pivots,
    "op4_warc": warc,
    "op5_token_output": token_store,
    "op6_fingerprints": minhash,
    "op7_ngram_jaccard_join": jaccard_join,
    "op8_quality_classifier": quality,
    "op9_sentencepiece": piece_fst,
    "op10_source_mixing": mixing,
}


def _query(module) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return module.query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if hasattr(module, "SQL")}
