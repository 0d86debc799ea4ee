"""Registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marisma.plans import analysis, articles, assessment, catalog, events, intake, jsons, payloads, places, prose, relations, rest, storage, surveillance, texts, upkeep, verify, web

_ALL = (texts, events, verify, relations, web, storage, analysis, articles, upkeep, places, surveillance, jsons, catalog, assessment, intake, payloads, prose, rest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _ALL for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _ALL for k, v in m.SQL.items()}
