"""The registered queries of the directory engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterlane.sources.fixtures import BASE, TABLES, table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None):
    """Register fn(t), t(name) being a table, under name; sql is the same query over the derived tables named in tables."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda n: table(spark, sf_dir, n))
        if sql is not None:
            ORACLES[name] = with_tables([n for n in tables.split() if n in TABLES and n not in BASE], sql)
        return fn

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["validation_run"](spark, sf_dir)


from rosterlane.plans import apply_queries, check_queries, extract_queries, match_queries, report_queries, score_queries, stream_queries  # noqa: E402, F401
