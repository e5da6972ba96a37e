"""Queries over the driver's tables, one or more for each operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexa.plans import books, formats, made, rules, text

Query = Callable[[SparkSession, str], DataFrame]
ALL = {**text.QUERIES, **books.QUERIES, **made.QUERIES, **formats.QUERIES, **rules.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
