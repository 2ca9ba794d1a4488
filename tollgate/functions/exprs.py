"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollgate.schemas import MEDIUM_THRESHOLD, OPERATIONAL_THRESHOLD


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double; 0.0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def is_finite(c: Column) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def sum_if(condition: Column, value: Column | None = None) -> Column:
    """Conditional sum that is 0, never NULL, when nothing matches."""
    if value is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return safe_ratio(F.lit(1 + b2) * precision * recall, F.lit(b2) * precision + recall)


def seeded_key(seed: int, *parts: Column | str) -> Column:
    """Deterministic pseudo-random hex key of a row: sha256('seed:part:part')."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.sha2(text, 256)


def hex_prefix(key: Column, digits: int = 15) -> Column:
    """Leading hex digits as a number; 15 digits stay inside a signed long."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def text_lanes(*parts: Column | str) -> list[Column]:
    """Four 32-bit lanes of the md5 of '#'-joined parts, each with its length; '~' stands for NULL.

    Summed over rows they make a fingerprint that does not depend on row order
    and that combines map-side.
    """

    def marked(part: Column) -> Column:
        return F.coalesce(F.concat(F.length(part).cast("string"), F.lit(":"), part), F.lit("~"))

    digest = F.md5(F.concat_ws("#", *[marked(col(p).cast("string")) for p in parts]))
    return [
        F.conv(F.substring(digest, 1 + 8 * lane, 8), 16, 10).cast("bigint") for lane in range(4)
    ]


def bin_of(x: Column, inner_edges: Sequence[float]) -> Column:
    """Index of the frozen bin: how many inner edges are <= x."""
    return reduce(add, [(x >= F.lit(float(e))).cast("int") for e in inner_edges], F.lit(0))


def le_bucket_of(x: Column, upper_bounds: Sequence[float]) -> Column:
    """Index of the first bucket whose inclusive upper bound holds x."""
    return reduce(add, [(x > F.lit(float(e))).cast("int") for e in upper_bounds], F.lit(0))


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin over [lo, hi], right edge closed; one-value ranges use bin 0."""
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor(F.coalesce(F.try_divide(x - lo, width), F.lit(0.0)))
    return F.least(raw, F.lit(bins - 1)).cast("int")


def predict(score: Column, threshold: float = OPERATIONAL_THRESHOLD) -> Column:
    return (score >= F.lit(threshold)).cast("int")


def risk_level(
    score: Column, high: float = OPERATIONAL_THRESHOLD, medium: float = MEDIUM_THRESHOLD
) -> Column:
    return (
        F.when(score >= F.lit(high), "high").when(score >= F.lit(medium), "medium").otherwise("low")
    )


def status_class(status: Column) -> Column:
    hundreds = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(status / 100).cast("int")))
    return F.concat(hundreds.cast("string"), F.lit("xx"))


def psi_severity(value: Column, stable_below: float = 0.10, moderate_below: float = 0.25) -> Column:
    """Severity of a PSI value; NULL means too few rows to tell."""
    return (
        F.when(value.isNull(), "insufficient_data")
        .when(value < stable_below, "stable")
        .when(value < moderate_below, "moderate")
        .otherwise("significant")
    )


def long_metrics(metrics: dict[str, Column]) -> Column:
    """One wide aggregate row to (metric, value) rows."""
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
                for name, value in metrics.items()
            ]
        )
    )


def logistic_score(
    features: Sequence[str],
    means: Sequence[float],
    scales: Sequence[float],
    weights: Sequence[float],
    intercept: float,
) -> Column:
    """Frozen standardised logistic model as one expression: streaming-safe, codegen-friendly."""
    terms = [
        F.lit(float(w)) * ((F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s)))
        for f, m, s, w in zip(features, means, scales, weights, strict=True)
    ]
    margin = reduce(add, terms, F.lit(float(intercept)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
