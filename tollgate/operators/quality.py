"""Data quality as counts, reports and quarantine. One pass each, combined map-side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.exprs import flag, is_finite, long_metrics, safe_ratio, text_lanes
from tollgate.schemas import (
    BINARY_COLUMNS,
    METRIC_SEVERITIES,
    NUMERIC_COLUMNS,
    OPERATIONAL_THRESHOLD,
    RISK_LEVELS,
    RUN_STATUSES,
    DRIFT_STATUSES,
    TRANSACTION_TYPES,
)

# Fixed value: the exclusive upper bound of a finite double in the audit schema.
MAX_DOUBLE = 1.7976931348623157e308


def number(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` AS DOUBLE)")


def missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN where the column is a float."""
    kind = dict(df.dtypes)[c]
    null = F.col(c).isNull()
    return null | F.isnan(c) if kind in ("double", "float") else null


def coercion_violations(
    landing: DataFrame, columns: Sequence[str] = tuple(NUMERIC_COLUMNS)
) -> DataFrame:
    """B1: values per numeric column that are present but are no number."""
    counts = landing.agg(
        *[F.count_if(F.col(c).isNotNull() & number(c).isNull()).alias(c) for c in columns]
    )
    return counts.unpivot([], list(columns), "column_name", "violations")


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B2: missing values per column, and in total under the name ``total``."""
    counts = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0))
    wide = counts.withColumn("total", total.cast("bigint"))
    return wide.unpivot([], [*columns, "total"], "column_name", "missing")


def negative_amounts(landing: DataFrame) -> DataFrame:
    """Rows with a negative amount."""
    return landing.agg(F.count_if(number("amount") < 0).alias("negative_amounts"))


def domain_violations(landing: DataFrame) -> DataFrame:
    """Distinct values outside their domain, with how often they occur; NULLs not counted."""
    pairs = [
        F.when(
            F.col(c).isNotNull() & ~F.coalesce(number(c).isin(0.0, 1.0), F.lit(False)),
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("bad_value")),
        )
        for c in BINARY_COLUMNS
    ]
    pairs.append(
        F.when(
            ~F.col("type").isin(TRANSACTION_TYPES),
            F.struct(F.lit("type").alias("column_name"), F.col("type").alias("bad_value")),
        )
    )
    return (
        landing.select(F.inline(F.array_compact(F.array(*pairs))))
        .groupBy("column_name", "bad_value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def quality_report(landing: DataFrame) -> DataFrame:
    """(section, metric, value) report over landing rows, status included as 1.0 = passed."""
    fraud, flagged = number("isFraud") == 1, number("isFlaggedFraud") == 1
    amount = number("amount")
    columns = [c for c in landing.columns if c != "txn_id"]
    broken = F.lit(False)
    for c in columns:
        broken = broken | missing(landing, c)
    for c in NUMERIC_COLUMNS:
        broken = broken | (F.col(c).isNotNull() & number(c).isNull())
    for c in BINARY_COLUMNS:
        broken = broken | ~F.coalesce(number(c).isin(0.0, 1.0), F.lit(False))
    broken = broken | (amount < 0) | ~F.col("type").isin(TRANSACTION_TYPES)
    per_type = landing.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(fraud).alias("fraud"),
        F.count_if(flagged).alias("flagged"),
        F.min(amount).alias("lo"),
        F.max(amount).alias("hi"),
        F.count_if(F.coalesce(broken, F.lit(True))).alias("broken"),
    )
    whole = per_type.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "fraud", "flagged", "broken")],
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    n, fraud_n = F.col("n"), F.col("fraud")
    summary = whole.select(
        F.lit("summary").alias("section"),
        long_metrics(
            {
                "total_rows": n,
                "fraud_count": fraud_n,
                "non_fraud_count": n - fraud_n,
                "fraud_percentage": safe_ratio(fraud_n, n) * 100,
                "flagged_fraud_count": F.col("flagged"),
                "amount_min": F.col("lo"),
                "amount_max": F.col("hi"),
                "passed": flag(F.col("broken") == 0),
            }
        ),
    )
    named = per_type.where(F.col("type").isNotNull())
    by_type = named.select(
        F.lit("transaction_count_by_type").alias("section"),
        F.col("type").alias("metric"),
        n.cast("double").alias("value"),
    )
    fraud_by_type = named.where(fraud_n > 0).select(
        F.lit("fraud_count_by_type").alias("section"),
        F.col("type").alias("metric"),
        fraud_n.cast("double").alias("value"),
    )
    return summary.unionByName(by_type).unionByName(fraud_by_type)


def reject_reasons() -> Column:
    """Why a row breaks the scoring contract; an empty array means it is valid."""
    reasons = []
    for c in ("step", "amount", "oldbalanceOrg", "oldbalanceDest"):
        reasons.append(F.when(~is_finite(number(c)), f"{c}_not_finite"))
    for c in ("amount", "oldbalanceOrg", "oldbalanceDest"):
        reasons.append(F.when(number(c) < 0, f"{c}_negative"))
    step = number("step")
    reasons.append(F.when((step < 1) | (step != F.floor(step)), "step_not_positive_integer"))
    reasons.append(
        F.when(~F.coalesce(F.col("type").isin(TRANSACTION_TYPES), F.lit(False)), "type_unknown")
    )
    return F.array_compact(F.array(*reasons))


def contract(df: DataFrame) -> DataFrame:
    """Add ``reject_reasons``."""
    return df.withColumn("reject_reasons", reject_reasons())


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reject_reasons") == 0).drop("reject_reasons")


def quarantine_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reject_reasons") > 0)


@dataclass(frozen=True)
class Check:
    """A row predicate that must not be false (SQL CHECK: NULL passes)."""

    name: str
    holds: Column


def _between(c: str, low: float, high: float) -> Column:
    return (F.col(c) >= low) & (F.col(c) <= high)


def _money(c: str) -> Check:
    holds = (F.col(c) >= 0) & (F.col(c) < F.lit(MAX_DOUBLE)) & ~F.isnan(c)
    return Check(f"{c}_finite_nonnegative", holds)


def request_checks() -> list[Check]:
    return [
        Check("payload_hash_length", F.length("payload_hash") == 64),
        Check("batch_size_positive", F.col("batch_size") > 0),
        Check("threshold_range", _between("threshold", 0, 1)),
        Check("processing_time_finite_nonnegative", _money("processing_time_ms").holds),
    ]


def event_checks() -> list[Check]:
    return [
        Check("item_index_nonnegative", F.col("item_index") >= 0),
        Check("step_positive", F.col("step") >= 1),
        Check("transaction_type_valid", F.col("transaction_type").isin(TRANSACTION_TYPES)),
        _money("amount"),
        _money("oldbalance_origin"),
        _money("oldbalance_destination"),
        Check("fraud_score_range", _between("fraud_score", 0, 1)),
        Check("prediction_valid", F.col("prediction").isin(0, 1)),
        Check("risk_level_valid", F.col("risk_level").isin(RISK_LEVELS)),
    ]


def outcome_checks() -> list[Check]:
    return [
        Check("actual_fraud_valid", F.col("actual_fraud").isin(0, 1)),
        Check("source_nonempty", F.length(F.trim("source")) > 0),
    ]


def run_checks() -> list[Check]:
    return [
        Check("window_order_valid", F.col("window_end") > F.col("window_start")),
        Check("event_count_nonnegative", F.col("event_count") >= 0),
        Check("labeled_count_nonnegative", F.col("labeled_count") >= 0),
        Check("labeled_count_within_events", F.col("labeled_count") <= F.col("event_count")),
        Check("reference_version_nonempty", F.length(F.trim("reference_version")) > 0),
        Check("status_valid", F.col("status").isin(RUN_STATUSES)),
        Check("overall_drift_status_valid", F.col("overall_drift_status").isin(DRIFT_STATUSES)),
    ]


def metric_checks() -> list[Check]:
    return [
        Check("metric_name_nonempty", F.length(F.trim("metric_name")) > 0),
        Check(
            "metric_value_finite",
            F.col("metric_value").isNull() | is_finite(F.col("metric_value")),
        ),
        Check("severity_valid", F.col("severity").isin(METRIC_SEVERITIES)),
        Check("sample_size_nonnegative", F.col("sample_size") >= 0),
    ]


def check_report(df: DataFrame, table: str, checks: Sequence[Check]) -> DataFrame:
    """Rows that break each check."""
    names = [c.name for c in checks]
    counts = df.agg(*[F.count_if(~c.holds).alias(c.name) for c in checks])
    return counts.unpivot([], names, "constraint_name", "violations").select(
        F.lit(table).alias("table_name"), "constraint_name", "violations"
    )


def unique_report(df: DataFrame, table: str, key: Sequence[str], name: str) -> DataFrame:
    """Keys that occur more than once; a key with a NULL part never collides."""
    present = df.dropna(subset=list(key))
    repeated = present.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return repeated.agg(F.count_if(F.col("n") > 1).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(name).alias("constraint_name"), "violations"
    )


def foreign_key_report(
    child: DataFrame, parent: DataFrame, table: str, key: str, name: str
) -> DataFrame:
    """Child rows without a parent.

    The child is counted per key first, so a key that holds a third of all rows is one row
    when the two sides meet.
    """
    held = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    orphans = held.join(parent.select(key), key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(name).alias("constraint_name"), "violations"
    )


def audit_constraints(requests: DataFrame, events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """B9 over the three ledger tables: one row per constraint, whatever columns exist."""

    def known(df: DataFrame, checks: list[Check], needs: dict[str, str]) -> list[Check]:
        return [c for c in checks if needs.get(c.name, "") in ("", *df.columns)]

    optional = {
        "payload_hash_length": "payload_hash",
        "threshold_range": "threshold",
        "processing_time_finite_nonnegative": "processing_time_ms",
    }
    parts = [
        check_report(
            requests, "prediction_requests", known(requests, request_checks(), optional)
        ),
        check_report(events, "prediction_events", event_checks()),
        check_report(outcomes, "prediction_outcomes", outcome_checks()),
        unique_report(requests, "prediction_requests", ["request_id"], "request_id_unique"),
        unique_report(events, "prediction_events", ["prediction_id"], "prediction_id_unique"),
        unique_report(
            events, "prediction_events", ["request_id", "item_index"], "request_item_unique"
        ),
        unique_report(outcomes, "prediction_outcomes", ["prediction_id"], "prediction_id_unique"),
        foreign_key_report(
            events, requests, "prediction_events", "request_id", "request_id_exists"
        ),
        foreign_key_report(
            outcomes, events, "prediction_outcomes", "prediction_id", "prediction_id_exists"
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and an md5 fold of the named columns; row order does not matter.

    All four lanes of the md5 are folded, as decimals that cannot overflow at any table size.
    """
    folds = [F.coalesce(F.sum(lane.cast("decimal(20,0)")), F.lit(0)) for lane in text_lanes(*columns)]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.concat_ws("-", *[f.cast("string") for f in folds]).alias("fingerprint"),
    )


def request_completeness(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Requests whose stored events are not exactly items 0 .. batch_size - 1, or that never
    completed (where completion columns exist)."""
    items = events.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.min("item_index").alias("first_item"),
        F.max("item_index").alias("last_item"),
    )
    done = F.lit(True)
    for c in ("completed_at", "processing_time_ms"):
        if c in requests.columns:
            done = done & F.col(c).isNotNull()
    size = F.col("batch_size")
    whole = (
        (F.col("items") == size) & (F.col("first_item") == 0) & (F.col("last_item") == size - 1)
    )
    return (
        requests.join(items, "request_id", "left")
        .withColumn("complete", F.coalesce(whole & done, F.lit(False)))
        .select("request_id", "batch_size", F.coalesce("items", F.lit(0)).alias("items"), "complete")
    )


def score_contract(scored: DataFrame, threshold: float = OPERATIONAL_THRESHOLD) -> DataFrame:
    """Violations per rule over scored rows with fraud_score, prediction, risk_level."""
    score = F.col("fraud_score")
    rules = {
        "score_finite_in_unit_range": is_finite(score) & score.between(0.0, 1.0),
        "prediction_binary": F.col("prediction").isin(0, 1),
        "risk_level_known": F.col("risk_level").isin(RISK_LEVELS),
    }
    if "threshold" in scored.columns:
        rules["threshold_frozen"] = F.col("threshold") == F.lit(threshold)
    counts = scored.agg(
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    )
    return counts.unpivot([], list(rules), "rule", "violations")
