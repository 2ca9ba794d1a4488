"""Attach one-row-per-key facts back to rows when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1 / HOT_SHARE of all rows, so there can be at most
# HOT_SHARE hot keys, whatever the data: that bounds what is broadcast.
HOT_SHARE = 5_000


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` on ``key``; ``weight`` is a key's number of rows.

    Rows of hot keys stay where they are and meet a broadcast of those few facts. All other
    rows go through the ordinary shuffle join, which then has no hot partition.
    """
    total = facts.agg(F.sum(weight)).scalar()
    marked = facts.withColumn(
        "_hot", F.col(weight).cast("double") * F.lit(HOT_SHARE) > total.cast("double")
    )
    hot = marked.where("_hot").drop("_hot", weight)
    cold = marked.where("NOT _hot").drop("_hot", weight)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)
