"""Chronological splits on whole time steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.exprs import safe_ratio
from tollgate.operators.ordered import running_totals
from tollgate.schemas import TARGET, ContractError
from tollgate.session import checkpointed


@dataclass(frozen=True)
class Boundaries:
    """Last step of train and of validation."""

    train: int
    validation: int

    def split(self, step: Column) -> Column:
        """D3: the split of a step."""
        return (
            F.when(step <= self.train, "train")
            .when(step <= self.validation, "validation")
            .otherwise("test")
        )


@dataclass(frozen=True)
class StepWindow:
    """Inclusive step range."""

    low: int
    high: int

    def contains(self, step: Column) -> Column:
        return step.between(self.low, self.high)


def step_histogram(df: DataFrame) -> DataFrame:
    """Rows and frauds per step."""
    return df.groupBy("step").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(TARGET).cast("bigint").alias("fraud_count"),
    )


def cumulative_steps(df: DataFrame) -> DataFrame:
    """Rows and frauds up to each step, and the step's ordinal; rows without a step do not count."""
    return running_totals(
        df.where(F.col("step").isNotNull()),
        "step",
        {
            "rows": F.count(F.lit(1)),
            "frauds": F.coalesce(F.sum(TARGET), F.lit(0)).cast("bigint"),
            "steps": F.max(F.lit(1)),
        },
        slab=F.floor(F.col("step") / 1024),
    )


def _nearest(target: Column, eligible: Column) -> Column:
    """Aggregate: the eligible step whose cumulative rows are nearest; ties to the lower step."""
    distance = F.abs(F.col("rows_upto") - target)
    best = F.min(F.when(eligible, F.struct(distance.alias("d"), F.col("step").alias("s"))))
    return best["s"]


def choose_boundaries(
    df: DataFrame, train_fraction: float = 0.70, validation_fraction: float = 0.15
) -> Boundaries:
    """Whole-step boundaries nearest the wanted fractions.

    The rows are read once, and folded to one per step; only chosen steps reach the driver. A second
    time they are read only where both boundaries fall on one step.
    """
    return _boundaries(cumulative_steps(df), train_fraction, validation_fraction)


def _boundaries(steps: DataFrame, train_fraction: float, validation_fraction: float) -> Boundaries:
    """D3 from D2's table."""
    if min(train_fraction, validation_fraction) <= 0 or train_fraction + validation_fraction >= 1:
        raise ContractError("split fractions must be positive and leave a test split")
    train_target = F.col("rows_total") * F.lit(train_fraction)
    both_target = F.col("rows_total") * F.lit(train_fraction + validation_fraction)
    inner = (F.col("steps_upto") > 1) & (F.col("steps_upto") < F.col("steps_total"))
    row = steps.agg(
        F.max("steps_total").alias("n"),
        _nearest(train_target, F.col("steps_upto") <= F.col("steps_total") - 2).alias("t"),
        _nearest(both_target, inner).alias("v"),
    ).first()
    if row["n"] is None or row["n"] < 3:
        raise ContractError("at least three time steps are required for three splits")
    train, validation = row["t"], row["v"]
    if validation <= train:
        # Cumulative rows only grow, so past the train boundary the next step is nearest.
        later = steps.where(inner & (F.col("step") > train))
        validation = later.agg(F.min("step").alias("v")).first()["v"]
        if validation is None:
            raise ContractError("no step is left for a validation split")
    return Boundaries(train, validation)


def split_summary(df: DataFrame, bounds: Boundaries) -> DataFrame:
    """Step range, rows, frauds and share of each split."""
    per = (
        step_histogram(df)
        .withColumn("split", bounds.split(F.col("step")))
        .groupBy("split")
        .agg(
            F.min("step").alias("step_minimum"),
            F.max("step").alias("step_maximum"),
            F.sum("row_count").alias("row_count"),
            F.sum("fraud_count").alias("fraud_count"),
        )
    )
    # Three rows by now: the total of a three-row table.
    total = per.agg(F.sum("row_count")).scalar()
    return per.select(
        "split",
        "step_minimum",
        "step_maximum",
        "row_count",
        "fraud_count",
        (F.col("row_count") - F.col("fraud_count")).alias("non_fraud_count"),
        (safe_ratio(F.col("fraud_count"), F.col("row_count")) * 100).alias("fraud_percentage"),
        safe_ratio(F.col("row_count"), total).alias("actual_fraction"),
    )


def split_checks(source: DataFrame, written: DataFrame) -> DataFrame:
    """Conservation, step overlap, order and class coverage of a written split dataset.

    ``written`` carries a ``split`` column; nothing is assumed about how it was assigned.
    """
    per_step = written.groupBy("step", "split").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(TARGET).cast("bigint").alias("fraud_count")
    )
    overlap = (
        per_step.groupBy("step").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1))
    ).scalar()
    before = source.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.coalesce(F.sum(TARGET), F.lit(0)).cast("bigint").alias("frauds_in"),
    )

    def of(split: str, value: Column) -> Column:
        return F.when(F.col("split") == split, value)

    step, rows, frauds = F.col("step"), F.col("row_count"), F.col("fraud_count")
    in_order = F.coalesce(
        (F.max(of("train", step)) < F.min(of("validation", step)))
        & (F.max(of("validation", step)) < F.min(of("test", step))),
        F.lit(False),
    )
    covered = F.lit(True)
    for s in ("train", "validation", "test"):
        fraud = F.coalesce(F.sum(of(s, frauds)), F.lit(0))
        plain = F.coalesce(F.sum(of(s, rows - frauds)), F.lit(0))
        covered = covered & (fraud > 0) & (plain > 0)
    wide = per_step.agg(
        (F.coalesce(F.sum(rows), F.lit(0)) == before.select("rows_in").scalar()).alias(
            "total_row_conservation"
        ),
        (F.coalesce(F.sum(frauds), F.lit(0)) == before.select("frauds_in").scalar()).alias(
            "total_fraud_conservation"
        ),
        in_order.alias("chronological_ordering_check"),
        covered.alias("class_coverage_check"),
    ).withColumn("no_step_overlap", overlap == 0)
    return wide.unpivot([], wide.columns, "check_name", "passed")


def audit_periods(
    df: DataFrame, train_fraction: float = 0.70, validation_fraction: float = 0.15,
    fit_fraction: float = 0.80,
) -> dict[str, StepWindow]:
    """Step windows of train, inner tuning and validation, from one table of steps."""
    steps = checkpointed(cumulative_steps(df))
    bounds = _boundaries(steps, train_fraction, validation_fraction)
    inner = _inner(steps.where(F.col("step") <= bounds.train), fit_fraction)
    return {
        "train": StepWindow(inner["inner_fit"].low, bounds.train),
        "inner_fit": inner["inner_fit"],
        "inner_tuning": inner["inner_tuning"],
        "official_validation": StepWindow(bounds.train + 1, bounds.validation),
    }


def period_counts(df: DataFrame, windows: dict[str, StepWindow]) -> DataFrame:
    """Rows and frauds in named step windows, in one pass over the histogram."""
    step = F.col("step")
    tags = F.array_compact(
        F.array(*[F.when(w.contains(step), F.lit(name)) for name, w in windows.items()])
    )
    return (
        step_histogram(df)
        .withColumn("period", F.explode(tags))
        .groupBy("period")
        .agg(
            F.min("step").alias("step_minimum"),
            F.max("step").alias("step_maximum"),
            F.sum("row_count").alias("row_count"),
            F.sum("fraud_count").alias("fraud_count"),
        )
        .withColumn(
            "fraud_percentage", safe_ratio(F.col("fraud_count"), F.col("row_count")) * 100
        )
    )


def inner_windows(train: DataFrame, fit_fraction: float = 0.80) -> dict[str, StepWindow]:
    """Fit and tuning step windows inside the training split."""
    return _inner(cumulative_steps(train), fit_fraction)


def _inner(steps: DataFrame, fit_fraction: float) -> dict[str, StepWindow]:
    """D6 from D2's table, or its first steps."""
    if not 0 < fit_fraction < 1:
        raise ContractError("fit fraction must lie between 0 and 1")
    whole = steps.agg(
        F.max("steps_upto").alias("n"),
        F.max("rows_upto").alias("rows"),
        F.min("step").alias("first"),
        F.max("step").alias("last"),
    ).first()
    if whole["n"] is None or whole["n"] < 2:
        raise ContractError("at least two time steps are required for inner tuning")
    target = F.lit(whole["rows"] * fit_fraction)
    cut = steps.agg(_nearest(target, F.col("step") < whole["last"]).alias("cut")).first()["cut"]
    late = F.col("step") > cut
    sides = steps.agg(
        F.min(F.when(late, F.col("step"))).alias("next"),
        F.sum(F.when(~late, F.col("frauds"))).alias("fit_frauds"),
        F.sum(F.when(late, F.col("frauds"))).alias("tuning_frauds"),
    ).first()
    if not sides["fit_frauds"] or not sides["tuning_frauds"]:
        raise ContractError("fit and tuning periods must both hold frauds")
    return {
        "inner_fit": StepWindow(whole["first"], cut),
        "inner_tuning": StepWindow(sides["next"], whole["last"]),
    }
