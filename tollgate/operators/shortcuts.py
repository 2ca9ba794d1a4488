"""H1-H6: duplicate patterns across splits, simple shortcut rules and the audit verdict."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.exprs import is_close, safe_ratio
from tollgate.functions.features import FEATURES, feature_columns
from tollgate.operators.chrono import StepWindow
from tollgate.operators.profile import with_periods
from tollgate.schemas import TARGET

# Tolerances of the rules.
RELATIVE_TOLERANCE = 1e-9
ABSOLUTE_TOLERANCE = 1e-6
RATIO_LIMIT = 0.99

# Limits of the verdict.
PRECISION_LIMIT = 0.5
RECALL_LIMIT = 0.9
DUPLICATE_LIMIT = 50.0


def pattern_columns(decimals: int | None = None) -> dict[str, Column]:
    """H1: the float features that identify a pattern, rounded half-even if asked.

    Rounding takes place in double precision, where a float times the scale is exact: as floats, 3.8795
    times 1000 is a half that it is not.
    """
    exprs = {n: c.cast("float") for n, c in feature_columns().items()}
    if decimals is None:
        return exprs
    scale = F.lit(float(10**decimals))
    return {n: (F.rint(c.cast("double") * scale) / scale).cast("float") for n, c in exprs.items()}


def duplicate_patterns(
    df: DataFrame,
    is_train: Column,
    is_validation: Column,
    decimals: int | None = None,
    columns: Sequence[str] = tuple(FEATURES),
) -> DataFrame:
    """H2: how many validation rows repeat a feature pattern of the training rows.

    Both splits are folded per pattern in one aggregation over one scan, so there is no
    join, and a pattern that a third of all rows share is one row after the map side.
    """
    patterns = pattern_columns(decimals)
    label = F.col("_label")
    per = (
        df.where(is_train | is_validation)
        .select(
            *[patterns[c].alias(c) for c in columns],
            F.col(TARGET).alias("_label"),
            is_train.alias("_train"),
        )
        .groupBy(*columns)
        .agg(
            F.count_if(F.col("_train")).alias("train_n"),
            F.coalesce(F.bool_or(F.col("_train") & (label == 0)), F.lit(False)).alias("train_0"),
            F.coalesce(F.bool_or(F.col("_train") & (label == 1)), F.lit(False)).alias("train_1"),
            F.count_if(~F.col("_train") & (label == 0)).alias("n0"),
            F.count_if(~F.col("_train") & (label == 1)).alias("n1"),
        )
    )
    t0, t1, n0, n1 = F.col("train_0"), F.col("train_1"), F.col("n0"), F.col("n1")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    both = n0 + n1
    counts = per.agg(
        total(F.col("train_n")).alias("train_rows"),
        total(both).alias("validation_rows"),
        F.count_if(F.col("train_n") > 0).alias("unique_train_feature_patterns"),
        total(F.when(t0 | t1, both)).alias("matching_validation_rows"),
        total(F.when(t0 & ~t1, n0).when(t1 & ~t0, n1)).alias("matching_same_label_rows"),
        total(F.when(t0 & ~t1, n1).when(t1 & ~t0, n0)).alias("matching_opposite_label_rows"),
        total(F.when(t0 & t1, both)).alias("matching_mixed_train_label_rows"),
    )
    matching = F.col("matching_validation_rows")
    return counts.select(
        F.lit(decimals).cast("int").alias("rounding_decimals"),
        "*",
        (safe_ratio(matching, F.col("validation_rows")) * 100).alias(
            "matching_validation_percentage"
        ),
        (safe_ratio(F.col("matching_same_label_rows"), matching) * 100).alias(
            "same_label_among_matches_percentage"
        ),
    )


def rules() -> dict[str, Column]:
    """H3: the twelve boolean pre-transaction rules."""
    kind, amount = F.col("type"), F.col("amount")
    origin, dest = F.col("oldbalanceOrg"), F.col("oldbalanceDest")
    transfer, cash_out = kind == "TRANSFER", kind == "CASH_OUT"
    either = transfer | cash_out
    equal = is_close(origin, amount, RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE)
    covers = amount >= origin - ABSOLUTE_TOLERANCE
    dest_zero = F.abs(dest) <= ABSOLUTE_TOLERANCE
    return {
        "type_TRANSFER": transfer,
        "type_CASH_OUT": cash_out,
        "oldbalanceOrg_equals_amount": equal,
        "amount_ge_oldbalanceOrg": covers,
        "oldbalanceOrg_zero": F.abs(origin) <= ABSOLUTE_TOLERANCE,
        "oldbalanceDest_zero": dest_zero,
        "amount_to_origin_balance_ge_0_99": amount / (origin + 1) >= RATIO_LIMIT,
        "transfer_or_cashout_and_amount_ge_oldbalanceOrg": either & covers,
        "transfer_or_cashout_and_oldbalanceOrg_equals_amount": either & equal,
        "transfer_and_oldbalanceDest_zero": transfer & dest_zero,
        "cashout_and_oldbalanceDest_zero": cash_out & dest_zero,
        "transfer_or_cashout_origin_equals_amount_dest_zero": either & equal & dest_zero,
    }


def rule_performance(df: DataFrame, periods: dict[str, StepWindow]) -> DataFrame:
    """H4: support, frauds, precision and recall of each rule in each period.

    A row's twelve answers are one bit mask, so a row costs one hash update; only the few
    (step, mask, label) counts are tagged with periods and turned long.
    """
    checks = rules()
    names = list(checks)
    mask = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(checks.values())],
    )
    low = df.groupBy("step", mask.alias("mask"), (F.col(TARGET) == 1).alias("fraud")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per = (
        with_periods(low, periods)
        .groupBy("period", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("fraud"), F.col("n"))), F.lit(0)).alias("f"),
        )
    )

    def has(i: int) -> Column:
        return F.col("mask").bitwiseAND(F.lit(1 << i)) != 0

    zero = F.lit(0).cast("bigint")
    wide = per.groupBy("period").agg(
        F.sum("f").alias("frauds"),
        *[F.coalesce(F.sum(F.when(has(i), F.col("n"))), zero).alias(f"s_{n}") for i, n in enumerate(names)],
        *[F.coalesce(F.sum(F.when(has(i), F.col("f"))), zero).alias(f"f_{n}") for i, n in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("rule"),
                F.col(f"s_{n}").alias("support"),
                F.col(f"f_{n}").alias("fraud_count"),
            )
            for n in names
        ]
    )
    return wide.select("period", "frauds", F.inline(rows)).select(
        "period",
        "rule",
        "support",
        "fraud_count",
        (F.col("support") - F.col("fraud_count")).alias("nonfraud_count"),
        safe_ratio(F.col("fraud_count"), F.col("support")).alias("precision"),
        safe_ratio(F.col("fraud_count"), F.col("frauds")).alias("recall"),
    )


def strongest_rule(performance: DataFrame, period: str = "official_validation") -> DataFrame:
    """H5: best rule by (recall, precision, support) and whether it is a shortcut."""
    best = performance.where(F.col("period") == period).agg(
        F.max_by(
            F.struct("rule", "support", "precision", "recall"),
            F.struct("recall", "precision", "support"),
        ).alias("b")
    )
    return best.select("b.*").withColumn(
        "shortcut_likely",
        (F.col("precision") > PRECISION_LIMIT) & (F.col("recall") > RECALL_LIMIT),
    )


def verdict(
    strongest: DataFrame,
    duplicates: DataFrame,
    permutation: DataFrame,
    metrics_reproduced: DataFrame,
    forbidden_features: Sequence[str] = (),
    features_as_documented: bool = True,
) -> DataFrame:
    """H6: the audit's flags as (flag_name, flag) rows. Every input is a one-row table.

    ``permutation`` has average_precision and fraud_prevalence of a model fitted on shuffled
    labels; ``metrics_reproduced`` has all_match.
    """
    collapsed = permutation.select(
        F.col("average_precision") <= F.greatest(F.lit(0.05), F.col("fraud_prevalence") * 5)
    ).scalar()
    reproduced = metrics_reproduced.select("all_match").scalar()
    repeats = duplicates.select(F.col("matching_validation_percentage") > DUPLICATE_LIMIT).scalar()
    leakage = F.lit(bool(forbidden_features))
    broken = ~reproduced | F.lit(not features_as_documented)
    legitimate = ~leakage & ~broken & collapsed & ~repeats
    wide = strongest.select(
        broken.alias("implementation_error"),
        leakage.alias("direct_feature_leakage"),
        F.col("shortcut_likely").alias("synthetic_shortcut_likely"),
        legitimate.alias("legitimate_model_performance"),
        (~leakage & ~broken & ~legitimate).alias("inconclusive"),
    )
    return wide.unpivot([], wide.columns, "flag_name", "flag")
