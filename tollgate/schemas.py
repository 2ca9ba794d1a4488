"""Table schemas, column roles and fixed domains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T


class ContractError(ValueError):
    """A table does not have the columns, domain or ordering an operator needs."""


# The source header, in order.
TRANSACTION_COLUMNS = [
    "step",
    "type",
    "amount",
    "nameOrig",
    "oldbalanceOrg",
    "newbalanceOrig",
    "nameDest",
    "oldbalanceDest",
    "newbalanceDest",
    "isFraud",
    "isFlaggedFraud",
]

# Domains.
TRANSACTION_TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
RISK_LEVELS = ["low", "medium", "high"]
SPLITS = ["train", "validation", "test"]
RUN_STATUSES = ["completed", "insufficient_data", "insufficient_labeled_data", "failed"]
DRIFT_STATUSES = ["stable", "moderate", "significant", "insufficient_data", "failed"]
METRIC_SEVERITIES = [
    "stable",
    "moderate",
    "significant",
    "insufficient_data",
    "informational",
    "unavailable",
]

# Column roles.
TARGET = "isFraud"
MODEL_INPUTS = ["step", "type", "amount", "oldbalanceOrg", "oldbalanceDest"]
IDENTIFIERS = ["nameOrig", "nameDest"]
POST_TRANSACTION = ["newbalanceOrig", "newbalanceDest"]
AUDIT_ONLY = ["isFlaggedFraud"]
FORBIDDEN_INPUTS = sorted([TARGET, *IDENTIFIERS, *POST_TRANSACTION, *AUDIT_ONLY])

NUMERIC_COLUMNS = [
    "step",
    "amount",
    "oldbalanceOrg",
    "newbalanceOrig",
    "oldbalanceDest",
    "newbalanceDest",
]
BINARY_COLUMNS = ["isFraud", "isFlaggedFraud"]
BALANCE_COLUMNS = ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]

# Production decision settings.
OPERATIONAL_THRESHOLD = 0.98310834
MEDIUM_THRESHOLD = 0.5
TOP_K_PERCENTAGES = [0.1, 0.5, 1.0]

_COLUMN_TYPES = {
    "step": T.LongType(),
    "isFraud": T.IntegerType(),
    "isFlaggedFraud": T.IntegerType(),
    "type": T.StringType(),
    "nameOrig": T.StringType(),
    "nameDest": T.StringType(),
}

TRANSACTION_SCHEMA = T.StructType(
    [T.StructField(c, _COLUMN_TYPES.get(c, T.DoubleType())) for c in TRANSACTION_COLUMNS]
)

# CSV lands as text so that a bad number becomes a counted violation, not a lost file.
LANDING_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in TRANSACTION_COLUMNS]
)

TRANSACTION_ITEM = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
    ]
)

PREDICTION_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("transactions", T.ArrayType(TRANSACTION_ITEM)),
    ]
)

OUTCOME_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("prediction_id", T.StringType()),
        T.StructField("actual_fraud", T.IntegerType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("source", T.StringType()),
    ]
)

MONITORING_RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("reference_version", T.StringType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("labeled_count", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("overall_drift_status", T.StringType()),
    ]
)

MONITORING_METRIC_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("sample_size", T.LongType()),
    ]
)


def check_header(actual: Iterable[str], expected: Iterable[str] = TRANSACTION_COLUMNS) -> None:
    """A2: the header must equal the expected one, order included."""
    actual, expected = list(actual), list(expected)
    if actual == expected:
        return
    missing = sorted(set(expected) - set(actual))
    unexpected = sorted(set(actual) - set(expected))
    raise ContractError(
        "header does not match the transaction schema; "
        f"missing: {missing or 'none'}; unexpected: {unexpected or 'none'}"
    )


def check_model_inputs(columns: Iterable[str]) -> None:
    """Only the five pre-transaction columns may reach a scorer."""
    columns = list(columns)
    forbidden = sorted(set(columns) & set(FORBIDDEN_INPUTS))
    missing = [c for c in MODEL_INPUTS if c not in columns]
    unexpected = [c for c in columns if c not in MODEL_INPUTS and c not in forbidden]
    if forbidden:
        raise ContractError(f"forbidden input columns: {', '.join(forbidden)}")
    if missing:
        raise ContractError(f"missing input columns: {', '.join(missing)}")
    if unexpected:
        raise ContractError(f"unexpected input columns: {', '.join(unexpected)}")


def check_profile_columns(columns: Iterable[str]) -> list[str]:
    """A reference profile may be built from model inputs only, each named once."""
    columns = list(columns)
    if not columns or len(set(columns)) != len(columns):
        raise ContractError("profile columns must be a unique, non-empty selection")
    if not set(columns) <= set(MODEL_INPUTS):
        raise ContractError("profile asks for a prohibited column")
    return columns


def check_profile_split(split: str) -> str:
    """Only the training split may feed a reference profile or a fit."""
    if split != "train":
        raise ContractError(f"only the train split may be used here, not {split!r}")
    return split
