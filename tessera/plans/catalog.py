"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import data_problems, graph, inference, lookups, maintenance, parsing, resolution, search, stats, stored, workflow

MODULES = (data_problems, search, resolution, graph, stats, inference, maintenance, workflow, parsing, lookups, stored)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
