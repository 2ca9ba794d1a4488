"""Seventeen pre-transaction features and their ablation groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.exprs import is_finite
from tollgate.schemas import MODEL_INPUTS, TRANSACTION_TYPES, ContractError

TIME_FEATURES = ["step", "hour_of_day", "hour_sin", "hour_cos"]
LOG_FEATURES = ["log_amount", "log_oldbalance_origin", "log_oldbalance_destination"]
BALANCE_RELATIONS = [
    "log_amount_to_origin_balance",
    "log_amount_to_destination_balance",
    "origin_balance_zero_before",
    "destination_balance_zero_before",
    "amount_exceeds_origin_balance",
]
TYPE_FEATURES = [f"type_{t}" for t in TRANSACTION_TYPES]

# Feature order.
FEATURES = TIME_FEATURES + LOG_FEATURES + BALANCE_RELATIONS + TYPE_FEATURES

# The ablation groups.
FEATURE_GROUPS = {
    "all_17_features": FEATURES,
    "without_time": [f for f in FEATURES if f not in TIME_FEATURES],
    "without_balance_relationships": [f for f in FEATURES if f not in BALANCE_RELATIONS],
    "type_and_amount_only": ["log_amount", *TYPE_FEATURES],
    "raw_pretransaction_core": ["step", *LOG_FEATURES, *TYPE_FEATURES],
}


def hour_of_day(step: Column) -> Column:
    return F.pmod(step - 1, F.lit(24))


def feature_columns() -> dict[str, Column]:
    """The feature expressions by name, in feature order."""
    step, amount = F.col("step"), F.col("amount")
    origin, dest = F.col("oldbalanceOrg"), F.col("oldbalanceDest")
    hour = hour_of_day(step)
    angle = F.lit(2 * math.pi) * hour / F.lit(24)
    out = {
        "step": step,
        "hour_of_day": hour,
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "log_amount": F.log1p(amount),
        "log_oldbalance_origin": F.log1p(origin),
        "log_oldbalance_destination": F.log1p(dest),
        "log_amount_to_origin_balance": F.log1p(amount / (origin + 1)),
        "log_amount_to_destination_balance": F.log1p(amount / (dest + 1)),
        "origin_balance_zero_before": origin == 0,
        "destination_balance_zero_before": dest == 0,
        "amount_exceeds_origin_balance": amount > origin,
    }
    for t in TRANSACTION_TYPES:
        out[f"type_{t}"] = F.col("type") == t
    return out


def add_features(
    df: DataFrame, keep: list[str] | None = None, allow_unknown_types: bool = False
) -> DataFrame:
    """Feature matrix as 17 float columns next to the columns named in ``keep``.

    ``keep`` columns that share a name with a feature (``step``) must not be asked for.
    Unknown types fail the query unless allowed; then their one-hot columns are all 0.
    """
    missing = [c for c in MODEL_INPUTS if c not in df.columns]
    if missing:
        raise ContractError(f"missing feature columns: {', '.join(missing)}")
    keep = keep or []
    clash = sorted(set(keep) & set(FEATURES))
    if clash:
        raise ContractError(f"kept columns hide features: {', '.join(clash)}")
    exprs = feature_columns()
    if not allow_unknown_types:
        known = F.col("type").isin(TRANSACTION_TYPES)
        failure = F.raise_error(F.concat(F.lit("unknown transaction type: "), F.col("type")))
        exprs["type_CASH_IN"] = F.when(known, exprs["type_CASH_IN"]).otherwise(
            failure.cast("boolean")
        )
    return df.select(*keep, *[e.cast("float").alias(n) for n, e in exprs.items()])


def not_finite_count(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """Rows per feature that are NULL, NaN or infinite; every count must be 0."""
    counts = features.agg(*[F.count_if(~is_finite(F.col(n))).alias(n) for n in names])
    return counts.unpivot([], names, "feature", "bad_rows")
