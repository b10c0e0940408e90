"""Queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, fm_index, pii, piece_codec, resample, simhash, token_store, toxic_crf, url_lists, warc

_MODULES = (warc, resample, exact_dedup, fm_index, piece_codec, url_lists, simhash, pii, token_store, toxic_crf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
