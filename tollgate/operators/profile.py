"""Profile aggregates. Few groups each, summed map-side before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.exprs import equal_width_bin, safe_ratio
from tollgate.functions.features import hour_of_day
from tollgate.operators.chrono import StepWindow
from tollgate.operators.ordered import exact_quantiles
from tollgate.schemas import BALANCE_COLUMNS, TARGET


def _fraud() -> Column:
    return F.col(TARGET) == 1


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(_fraud()).alias("fraud_count"),
    ]


def _rate() -> Column:
    return safe_ratio(F.col("fraud_count"), F.col("row_count")) * 100


def class_balance(df: DataFrame) -> DataFrame:
    """E1."""
    return (
        df.agg(*_counts())
        .withColumn("non_fraud_count", F.col("row_count") - F.col("fraud_count"))
        .withColumn("fraud_percentage", _rate())
    )


def fraud_by_type(df: DataFrame) -> DataFrame:
    """Types with no fraud have a NULL fraud count and a rate of 0."""
    per = df.where(F.col("type").isNotNull()).groupBy("type").agg(*_counts())
    return per.select(
        "type",
        F.col("row_count").alias("transaction_count"),
        F.when(F.col("fraud_count") > 0, F.col("fraud_count")).alias("fraud_count"),
        _rate().alias("fraud_rate"),
    )


def fraud_by_step(df: DataFrame) -> DataFrame:
    """E3."""
    return df.groupBy("step").agg(*_counts()).withColumn("fraud_rate", _rate())


def amount_statistics(df: DataFrame) -> DataFrame:
    """A single row has a standard deviation of 0."""
    return df.groupBy(F.col(TARGET).alias("label")).agg(
        F.count("amount").alias("row_count"),
        F.min("amount").alias("minimum"),
        F.max("amount").alias("maximum"),
        F.avg("amount").alias("mean"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("standard_deviation"),
    )


def balance_statistics(df: DataFrame, columns: Sequence[str] = tuple(BALANCE_COLUMNS)) -> DataFrame:
    """E5: one wide aggregate per class, turned long afterwards (no row is copied)."""
    stats = {"row_count": F.count, "minimum": F.min, "maximum": F.max, "mean": F.avg}
    wide = df.groupBy(F.col(TARGET).alias("label")).agg(
        *[fn(c).alias(f"{c}_{s}") for c in columns for s, fn in stats.items()]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}_{s}").alias(s) for s in stats])
            for c in columns
        ]
    )
    return wide.select("label", F.inline(rows))


def flag_crosstab(df: DataFrame) -> DataFrame:
    """Cells that do not occur are absent."""
    return df.groupBy(
        F.col("isFlaggedFraud").alias("flagged"), F.col(TARGET).alias("fraud")
    ).agg(F.count(F.lit(1)).alias("row_count"))


def zero_balances(df: DataFrame, columns: Sequence[str] = tuple(BALANCE_COLUMNS)) -> DataFrame:
    """Zero balances per column, as count and percentage."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c) == 0).alias(c) for c in columns]
    )
    return wide.unpivot(["n"], list(columns), "column_name", "zero_count").select(
        "column_name",
        "zero_count",
        (safe_ratio(F.col("zero_count"), F.col("n")) * 100).alias("percentage"),
    )


def amount_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins per class over that class's positive amounts."""
    rows = df.where(F.col("amount") > 0).select(F.col(TARGET).alias("label"), "amount")
    spans = rows.groupBy("label").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    return (
        rows.join(spans, "label")
        .withColumn("bin", equal_width_bin(F.col("amount"), F.col("lo"), F.col("hi"), bins))
        .groupBy("label", "bin")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def with_periods(df: DataFrame, periods: dict[str, StepWindow]) -> DataFrame:
    """Tag rows with every period that holds their step; periods may overlap."""
    tags = F.array_compact(
        F.array(*[F.when(w.contains(F.col("step")), F.lit(p)) for p, w in periods.items()])
    )
    return df.withColumn("period", F.explode(tags))


def _by_period(df: DataFrame, periods: dict[str, StepWindow], group: str, value: Column) -> DataFrame:
    """Counts per group and period: the groups shrink first, then the few rows are tagged."""
    low = df.groupBy("step", value.alias(group)).agg(*_counts())
    return (
        with_periods(low, periods)
        .groupBy("period", group)
        .agg(F.sum("row_count").alias("row_count"), F.sum("fraud_count").alias("fraud_count"))
    )


def hour_histogram(df: DataFrame, periods: dict[str, StepWindow]) -> DataFrame:
    """E9."""
    return _by_period(df, periods, "hour", hour_of_day(F.col("step")))


def type_histogram(df: DataFrame, periods: dict[str, StepWindow]) -> DataFrame:
    """E10."""
    return _by_period(df, periods, "type", F.col("type"))


def _two_quantiles(df: DataFrame, periods: dict[str, StepWindow], value: Column) -> DataFrame:
    rows = with_periods(
        df.select("step", F.col(TARGET).alias("label"), value.alias("value")), periods
    )
    found = exact_quantiles(rows, "value", {"median": 0.5, "p95": 0.95}, by=["period", "label"])
    return found.select("period", "label", "median", "p95")


def balance_gap(df: DataFrame, periods: dict[str, StepWindow]) -> DataFrame:
    """Median and p95 of |oldbalanceOrg - amount|; classes without rows have no row."""
    return _two_quantiles(df, periods, F.abs(F.col("oldbalanceOrg") - F.col("amount")))


def balance_ratio(df: DataFrame, periods: dict[str, StepWindow]) -> DataFrame:
    """Median and p95 of amount / (oldbalanceOrg + 1)."""
    return _two_quantiles(df, periods, F.col("amount") / (F.col("oldbalanceOrg") + 1))
