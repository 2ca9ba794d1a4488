"""Registry of runnable queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.plans.views_sql import BASE
from tollgate.sources import canonical

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is a SELECT (or further CTEs, then a SELECT) over the views."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            ORACLES[name] = BASE + (",\n" if body[:1] == "+" else "\n") + body.lstrip("+")
        return fn

    return register


def marked_text(column: str) -> str:
    """SQL of a column's text with its length before it, as in a fingerprint; '~' for NULL."""
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(length({text}) || ':' || {text}, '~')"


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.transactions(spark, sf_dir)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, so that summation order does not show."""
    return df.select(
        *[
            F.round(c, special.get(c, digits)).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )
