"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: its module here.
_QUERIES = {
    "op1_packing": "packing",
    "op2_simhash": "simhash",
    "op3_wavelet_tokens": "wavelet",
    "op4_ppm_language": "ppm",
    "op5_chat_windows": "chat",
    "op6_temperature_mixing": "mixing",
    "op7_lexicon_toxicity": "toxicity",
    "op8_pivot_topk": "topk",
    "op9_byte_quality": "quality",
    "op10_projection_forest": "forest",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    found = {name: getattr(import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for name, module in _QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
