"""Queries written as PostgreSQL-flavoured text and run through the engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.engine import Engine
from brindle.sources.tables import TABLES

Query = Callable[[SparkSession, str], DataFrame]


def used_tables(sql: str) -> list[str]:
    """Names of known tables in a text."""
    words = set(re.findall(r"[a-z_]+", sql))
    return [t for t in TABLES if t in words]


def text_query(sql: str) -> Query:
    """A query that runs ``sql`` over the tables of a folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark, tables_dir=sf_dir, tables=used_tables(sql)).sql(sql)

    run.__doc__ = sql
    return run
