"""K5, K6: minute totals and trailing windows built from them.

A trailing 24 h window that moves every minute would copy each event 1440 times. Minute
totals are additive, so a window is the difference of two running sums over minutes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.operators.drift import (
    EVENT_COLUMN,
    CategoricalProfile,
    NumericProfile,
    ReferenceProfile,
    with_bins,
)

# The levels of a decision.
RISK_LEVELS = ("low", "medium", "high")
_OUTPUTS = ["prediction", "risk_level", "fraud_score"]


def event_bins(events: DataFrame, profile: ReferenceProfile, time: str) -> DataFrame:
    """Time, bins and model outputs of each event: what minute totals are made of."""
    return with_bins(events, profile, EVENT_COLUMN, keep=[time, *_OUTPUTS])


def minute_items(profile: ReferenceProfile, count: Column, score: Column) -> Column:
    """Array of (series, bucket, n, total) that ``count`` like events add to their minute."""

    def item(series: str, bucket: Column, total: Column) -> Column:
        return F.struct(
            F.lit(series).alias("series"),
            bucket.cast("string").alias("bucket"),
            count.cast("bigint").alias("n"),
            total.cast("double").alias("total"),
        )

    parts = [item(p.feature, F.col(f"b{i}"), count) for i, p in enumerate(profile.parts)]
    return F.array(
        *parts,
        item("prediction", F.col("prediction"), count),
        item("risk_level", F.col("risk_level"), count),
        item("fraud_score", F.lit("sum"), score),
    )


def minute_totals(events: DataFrame, profile: ReferenceProfile, minute: Column) -> DataFrame:
    """K5: one row per (minute, series, bucket).

    All buckets are known from the profile and the decision's domain, so one aggregate by minute
    counts them side by side; events are folded map-side, and only minutes go long.
    """
    bins = event_bins(events.withColumn("_minute", minute), profile, "_minute")
    places = [(p.feature, f"b{i}", n) for i, p in enumerate(profile.parts) for n in range(_buckets(p))]
    places += [("prediction", "prediction", n) for n in (0, 1)]
    places += [("risk_level", "risk_level", level) for level in RISK_LEVELS]
    counts = [F.count_if(F.col(c) == F.lit(value)).alias(f"n{i}") for i, (_, c, value) in enumerate(places)]
    wide = bins.groupBy(F.col("_minute").alias("minute")).agg(
        F.count("fraud_score").alias("scored"), F.sum("fraud_score").alias("score"), *counts
    )

    def item(series: str, bucket: object, n: Column, total: Column) -> Column:
        return F.struct(
            F.lit(series).alias("series"), F.lit(str(bucket)).alias("bucket"), n.alias("n"), total.cast("double").alias("total")
        )

    items = [item(name, value, F.col(f"n{i}"), F.col(f"n{i}")) for i, (name, _, value) in enumerate(places)]
    items.append(item("fraud_score", "sum", F.col("scored"), F.col("score")))
    return wide.select("minute", F.inline(F.array(*items))).where("n > 0")


def _buckets(part: NumericProfile | CategoricalProfile) -> int:
    """Bins of a numeric feature; categories and the unknown bucket of another."""
    return len(part.edges) - 1 if isinstance(part, NumericProfile) else len(part.categories) + 1


def trailing_totals(
    minutes: DataFrame,
    ends: Column,
    length: Column,
    keys: Sequence[str] = ("series", "bucket"),
    sums: Sequence[str] = ("n", "total"),
) -> DataFrame:
    """K6: per key and window end, sums over minutes in [end - length, end).

    ``ends`` is an array expression of window ends. Rows per key are bounded by minutes plus
    ends, not by events. Marker rows carry zero and take part in the running sum, so the value
    at a marker is everything strictly before it.
    """
    keys = list(keys)
    real = minutes.select(*keys, F.col("minute").alias("at"), F.lit(1).alias("late"), *sums)
    zero = [F.lit(0).cast(dict(minutes.dtypes)[s]).alias(s) for s in sums]
    marks = (
        minutes.select(*keys)
        .distinct()
        .select(*keys, F.explode(ends).alias("window_end"))
        .select(
            *keys,
            "window_end",
            F.inline(
                F.array(
                    F.struct(F.col("window_end").alias("at"), F.lit("end").alias("edge")),
                    F.struct((F.col("window_end") - length).alias("at"), F.lit("start").alias("edge")),
                )
            ),
        )
        .select(*keys, "at", F.lit(0).alias("late"), "window_end", "edge", *zero)
    )
    running = (
        Window.partitionBy(*keys)
        .orderBy("at", "late")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    walked = (
        real.unionByName(marks, allowMissingColumns=True)
        .withColumns({f"_{s}": F.sum(s).over(running) for s in sums})
        .where(F.col("late") == 0)
    )

    def edge(name: str, s: str) -> Column:
        return F.max(F.when(F.col("edge") == name, F.col(f"_{s}")))

    return walked.groupBy(*keys, "window_end").agg(
        *[(edge("end", s) - edge("start", s)).alias(s) for s in sums]
    )
