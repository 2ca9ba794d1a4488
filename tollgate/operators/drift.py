"""Reference profiles, PSI drift, delayed performance and monitoring runs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.functions.exprs import bin_of, f_beta, is_finite, psi_severity, safe_ratio, sum_if
from tollgate.operators.ledger import time_literal
from tollgate.operators.ordered import exact_quantiles
from tollgate.schemas import RISK_LEVELS, ContractError, check_profile_columns, check_profile_split

UNKNOWN = "__unknown__"

# Feature name, source column, transformation.
NUMERIC_FEATURES = [
    ("step", "step", "identity"),
    ("log1p(amount)", "amount", "log1p"),
    ("log1p(oldbalanceOrg)", "oldbalanceOrg", "log1p"),
    ("log1p(oldbalanceDest)", "oldbalanceDest", "log1p"),
]

# Ledger column of each profile column.
EVENT_COLUMN = {
    "step": "step",
    "type": "transaction_type",
    "amount": "amount",
    "oldbalanceOrg": "oldbalance_origin",
    "oldbalanceDest": "oldbalance_destination",
}

PERFORMANCE_METRICS = [
    "precision",
    "recall",
    "f1",
    "f2",
    "false_positive_rate",
    "fraud_amount_recall",
]
SEVERITY_ORDER = ["insufficient_data", "stable", "moderate", "significant"]


@dataclass(frozen=True)
class MonitoringConfig:
    """Fixed values of the monitoring settings, overridable."""

    version: str = "train_v1"
    window_hours: int = 24
    minimum_events: int = 20
    minimum_labeled_events: int = 20
    quantile_bins: int = 10
    epsilon: float = 1e-6
    stable_below: float = 0.10
    moderate_below: float = 0.25

    def __post_init__(self) -> None:
        if self.minimum_events <= 0 or self.minimum_labeled_events <= 0:
            raise ContractError("minimum sample sizes must be positive")
        if not 0 < self.epsilon < float("inf"):
            raise ContractError("epsilon must be finite and positive")


@dataclass(frozen=True)
class NumericProfile:
    feature: str
    column: str
    transformation: str
    edges: list[float]
    counts: list[int]
    missing: int = 0

    @property
    def inner_edges(self) -> list[float]:
        return self.edges[1:-1]

    def value(self, source: Column) -> Column:
        """What is binned; NULL when it is not finite.

        A negative input to log1p fails the query, as it must not pass for drift.
        """
        return F.when(is_finite(source), transformed(source, self.transformation))

    def bin(self, value: Column) -> Column:
        """How many of the frozen inner edges are <= value."""
        return F.when(value.isNotNull(), bin_of(value, self.inner_edges))


@dataclass(frozen=True)
class CategoricalProfile:
    feature: str
    column: str
    categories: list[str]
    counts: list[int]
    missing: int = 0

    def value(self, source: Column) -> Column:
        return source

    def bin(self, value: Column) -> Column:
        """Position of a category; anything else, NULL included, is the unknown bucket."""
        place = F.lit(len(self.categories))
        for i, c in reversed(list(enumerate(self.categories))):
            place = F.when(value == c, F.lit(i)).otherwise(place)
        return place


@dataclass(frozen=True)
class ReferenceProfile:
    """A frozen profile: a few dozen numbers, saved as one small document."""

    version: str
    numeric: list[NumericProfile]
    categorical: list[CategoricalProfile]
    row_count: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def parts(self) -> list[NumericProfile | CategoricalProfile]:
        return [*self.numeric, *self.categorical]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> ReferenceProfile:
        raw = json.loads(text)
        raw["numeric"] = [NumericProfile(**p) for p in raw["numeric"]]
        raw["categorical"] = [CategoricalProfile(**p) for p in raw["categorical"]]
        return ReferenceProfile(**raw)

    def rows(self) -> list[tuple]:
        out = []
        for p in self.numeric:
            total = sum(p.counts)
            for i, n in enumerate(p.counts):
                share = n / total if total else 0.0
                out.append((p.feature, i, None, p.edges[i], p.edges[i + 1], n, share))
        for p in self.categorical:
            total = sum(p.counts)
            for i, n in enumerate(p.counts):
                name = p.categories[i] if i < len(p.categories) else UNKNOWN
                share = n / total if total else 0.0
                out.append((p.feature, i, name, None, None, n, share))
        return out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The profile as a long table (about 45 rows)."""
        return spark.createDataFrame(
            self.rows(),
            "feature string, bucket int, label string, lower double, upper double, "
            "ref_count bigint, ref_prop double",
        )


def transformed(source: Column, transformation: str) -> Column:
    if transformation == "identity":
        return source.cast("double")
    if transformation == "log1p":
        bad = F.raise_error(F.lit("log1p drift inputs must be non-negative")).cast("double")
        return F.when(source < 0, bad).otherwise(F.log1p(source))
    raise ContractError(f"unsupported transformation: {transformation}")


def quantile_edges(
    train: DataFrame, bins: int = 10, features: Sequence[tuple[str, str, str]] = tuple(NUMERIC_FEATURES)
) -> DataFrame:
    """Linear quantile edges per numeric feature, before repeated edges are dropped.

    All features share one pass: values go long, distinct values are ranked per feature.
    """
    check_profile_columns([c for _, c, _ in features])
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.when(is_finite(F.col(c)), transformed(F.col(c), how)).alias("value"),
            )
            for name, c, how in features
        ]
    )
    values = train.select(F.inline(rows)).where(F.col("value").isNotNull())
    points = {f"e{i}": i / bins for i in range(bins + 1)}
    wide = exact_quantiles(values, "value", points, by=["feature"])
    return wide.select("feature", F.array(*points).alias("edges"), "n")


def with_bins(
    df: DataFrame, profile: ReferenceProfile, columns: dict[str, str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The kept columns and one bin column ``b0``, ``b1``, ... per profiled feature.

    Values are computed in a projection of their own: each is compared with many edges, and its
    logarithm should be taken once.
    """
    columns = columns or {}
    parts = profile.parts
    values = df.select(
        *keep,
        *[
            p.value(F.col(columns.get(p.column, p.column))).alias(f"v{i}")
            for i, p in enumerate(parts)
        ],
    )
    return values.select(*keep, *[p.bin(F.col(f"v{i}")).alias(f"b{i}") for i, p in enumerate(parts)])


def bucket_counts(
    df: DataFrame, profile: ReferenceProfile, columns: dict[str, str] | None = None
) -> DataFrame:
    """Rows per (feature, bucket). Each row meets one hash entry, that of its bin tuple; only the
    tuples, at most a few ten thousand, are turned long."""
    parts = profile.parts
    tuples = (
        with_bins(df, profile, columns)
        .groupBy(*[f"b{i}" for i in range(len(parts))])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = F.array(
        *[
            F.struct(F.lit(p.feature).alias("feature"), F.col(f"b{i}").alias("bucket"))
            for i, p in enumerate(parts)
        ]
    )
    return (
        tuples.select("n", F.inline(rows))
        .where(F.col("bucket").isNotNull())
        .groupBy("feature", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def freeze_profile(
    train: DataFrame, config: MonitoringConfig = MonitoringConfig(), split: str = "train"
) -> ReferenceProfile:
    """Build the frozen reference from the training split.

    About 45 edges and as many counts reach the driver; they are the profile.
    """
    check_profile_split(split)
    found = {r["feature"]: r["edges"] for r in quantile_edges(train, config.quantile_bins).collect()}
    numeric = []
    for name, column, how in NUMERIC_FEATURES:
        if name not in found:
            raise ContractError(f"reference feature {name} has no finite values")
        edges = sorted(set(found[name]))
        if len(edges) == 1:
            edges = edges * 2
        numeric.append(NumericProfile(name, column, how, edges, [0] * (len(edges) - 1)))
    kinds = sorted(
        r["type"] for r in train.where("type IS NOT NULL").select("type").distinct().collect()
    )
    if not kinds:
        raise ContractError("reference feature type has no values")
    shape = ReferenceProfile(
        config.version, numeric, [CategoricalProfile("type", "type", kinds, [])]
    )
    counts = {(r["feature"], r["bucket"]): r["n"] for r in bucket_counts(train, shape).collect()}
    total = sum(n for (f, _), n in counts.items() if f == "type")
    done = []
    for p in numeric:
        n = [counts.get((p.feature, i), 0) for i in range(len(p.edges) - 1)]
        done.append(
            NumericProfile(p.feature, p.column, p.transformation, p.edges, n, total - sum(n))
        )
    n = [counts.get(("type", i), 0) for i in range(len(kinds))]
    missing = counts.get(("type", len(kinds)), 0)
    return ReferenceProfile(
        config.version, done, [CategoricalProfile("type", "type", kinds, [*n, 0], missing)], total
    )


def population_stability(buckets: DataFrame, config: MonitoringConfig = MonitoringConfig()) -> DataFrame:
    """J4-J8 over (feature, ref_prop, n) bucket rows: PSI, severity and sample size per feature.

    Both distributions are normalised, then floored at epsilon without normalising again.
    """
    per = Window.partitionBy("feature")
    eps = F.lit(config.epsilon)
    rows = buckets.withColumns(
        {
            "size": F.sum("n").over(per),
            "r": F.greatest(safe_ratio(F.col("ref_prop"), F.sum("ref_prop").over(per)), eps),
        }
    ).withColumn("c", F.greatest(safe_ratio(F.col("n"), F.col("size")), eps))
    psi = F.greatest(F.lit(0.0), F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))))
    return (
        rows.groupBy("feature")
        .agg(F.max("size").cast("bigint").alias("sample_size"), psi.alias("psi"))
        .select(
            "feature",
            F.when(F.col("sample_size") >= config.minimum_events, F.col("psi")).alias("psi"),
            "sample_size",
        )
        .withColumn(
            "severity", psi_severity(F.col("psi"), config.stable_below, config.moderate_below)
        )
    )


def feature_drift(
    current: DataFrame,
    profile: ReferenceProfile,
    config: MonitoringConfig = MonitoringConfig(),
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """PSI per feature of current rows against a frozen profile."""
    counts = bucket_counts(current, profile, columns)
    buckets = (
        profile.to_frame(current.sparkSession)
        .join(counts, ["feature", "bucket"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    return population_stability(buckets, config)


def overall_drift(drift: DataFrame) -> DataFrame:
    """The worst severity; insufficient only when every feature is."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    return drift.agg(
        F.coalesce(F.max_by("severity", rank), F.lit("insufficient_data")).alias(
            "overall_drift_status"
        )
    )


def _metric(name: Column | str, feature: str | None, value: Column, size: Column) -> Column:
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("metric_name"),
        F.lit(feature).cast("string").alias("feature_name"),
        value.cast("double").alias("metric_value"),
        F.when(value.isNotNull(), "informational").otherwise("unavailable").alias("severity"),
        size.cast("bigint").alias("sample_size"),
    )


def output_metrics(events: DataFrame, windows: dict[str, Column]) -> DataFrame:
    """Alert rate, mean score and distributions, per named window, in one pass.

    ``windows`` maps a metric prefix ('' and 'previous_window_') to the rows it covers. Every
    value of a domain has a row; an empty window gives NULLs.
    """
    aggs, metrics = [], []
    for i, (prefix, inside) in enumerate(windows.items()):
        aggs += [
            F.count_if(inside).alias(f"n{i}"),
            sum_if(inside, F.col("fraud_score")).alias(f"s{i}"),
            *[F.count_if(inside & (F.col("prediction") == v)).alias(f"p{i}_{v}") for v in (0, 1)],
            *[
                F.count_if(inside & (F.col("risk_level") == v)).alias(f"r{i}_{v}")
                for v in RISK_LEVELS
            ],
        ]
        size = F.col(f"n{i}")

        def share(c: str, size: Column = size) -> Column:
            return F.try_divide(F.col(c).cast("double"), size.cast("double"))

        metrics += [
            _metric(f"{prefix}alert_rate", None, share(f"p{i}_1"), size),
            _metric(f"{prefix}mean_fraud_score", None, share(f"s{i}"), size),
            *[
                _metric(f"{prefix}prediction_distribution", str(v), share(f"p{i}_{v}"), size)
                for v in (0, 1)
            ],
            *[
                _metric(f"{prefix}risk_level_distribution", v, share(f"r{i}_{v}"), size)
                for v in RISK_LEVELS
            ],
        ]
    return events.agg(*aggs).select(F.inline(F.array(*metrics)))


def performance(events: DataFrame, minimum_labeled: int = 20) -> DataFrame:
    """One row with status, labelled rows and the six metrics (NULL when too few labels)."""
    actual, predicted, amount = F.col("actual_fraud"), F.col("prediction"), F.col("amount")
    labeled = actual.isNotNull()
    bad = labeled & (
        ~F.coalesce(actual.isin(0, 1) & predicted.isin(0, 1), F.lit(False))
        | ~is_finite(amount)
        | (amount < 0)
    )
    wide = events.agg(
        F.count_if(labeled).alias("labeled_count"),
        F.count_if(bad).alias("bad"),
        F.count_if((predicted == 1) & (actual == 1)).alias("tp"),
        F.count_if((predicted == 1) & (actual == 0)).alias("fp"),
        F.count_if((predicted == 0) & (actual == 1)).alias("fn"),
        F.count_if((predicted == 0) & (actual == 0)).alias("tn"),
        sum_if(actual == 1, amount).alias("money"),
        sum_if((actual == 1) & (predicted == 1), amount).alias("caught"),
    )
    enough = F.col("labeled_count") >= minimum_labeled
    failure = F.raise_error(F.lit("labels must be 0 or 1 and amounts finite and non-negative"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    values = {
        "precision": precision,
        "recall": recall,
        "f1": f_beta(precision, recall, 1.0),
        "f2": f_beta(precision, recall, 2.0),
        "false_positive_rate": safe_ratio(fp, fp + tn),
        "fraud_amount_recall": safe_ratio(F.col("caught"), F.col("money")),
    }
    status = (
        F.when(~enough, "insufficient_labeled_data")
        .when(F.col("bad") > 0, failure.cast("string"))
        .otherwise("available")
    )
    return wide.select(
        status.alias("status"),
        "labeled_count",
        *[F.when(enough, v).alias(n) for n, v in values.items()],
    )


def performance_metrics(result: DataFrame) -> DataFrame:
    """performance_available, and the six metrics only when they exist."""
    available = F.when(F.col("status") == "available", 1.0).otherwise(0.0)
    size = F.col("labeled_count")
    rows = [_metric("performance_available", None, available, size)]
    rows += [_metric(n, None, F.col(n), size) for n in PERFORMANCE_METRICS]
    return result.select(F.inline(F.array(*rows))).where(F.col("metric_value").isNotNull())


def window_bounds(end: datetime, hours: int) -> tuple[datetime, datetime, datetime]:
    """Start of the previous window, start and end of the current one, whole seconds, UTC."""
    if end.tzinfo is None:
        raise ValueError("monitoring window end must be timezone-aware")
    end = end.astimezone(timezone.utc).replace(microsecond=0)
    start = end - timedelta(hours=hours)
    return start - timedelta(hours=hours), start, end


def monitoring_metrics(
    events: DataFrame,
    outcomes: DataFrame,
    profile: ReferenceProfile,
    end: datetime,
    config: MonitoringConfig = MonitoringConfig(),
) -> DataFrame:
    """Every metric row of one run (about 26 rows) for the window that ends at ``end``."""
    previous, start, end = window_bounds(end, config.window_hours)
    created = F.col("created_at")

    def at(t: datetime) -> Column:
        return time_literal(events, "created_at", t)

    both = events.where((created >= at(previous)) & (created < at(end)))
    current = both.where(created >= at(start))
    labeled = current.select("prediction_id", "prediction", "amount").join(
        outcomes.select("prediction_id", "actual_fraud"), "prediction_id", "left"
    )
    drift = feature_drift(current, profile, config, EVENT_COLUMN).select(
        F.lit("feature_psi").alias("metric_name"),
        F.col("feature").alias("feature_name"),
        F.col("psi").alias("metric_value"),
        "severity",
        "sample_size",
    )
    outputs = output_metrics(
        both, {"": created >= at(start), "previous_window_": created < at(start)}
    )
    labels = performance_metrics(performance(labeled, config.minimum_labeled_events))
    return drift.unionByName(outputs).unionByName(labels)


def run_summary(
    metrics: DataFrame, end: datetime, config: MonitoringConfig = MonitoringConfig()
) -> DataFrame:
    """The run row that belongs to a run's metric rows."""
    _, start, end = window_bounds(end, config.window_hours)

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("metric_name") == name, F.col(value)))

    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    psi = F.col("metric_name") == "feature_psi"
    wide = metrics.agg(
        F.coalesce(of("alert_rate", "sample_size"), F.lit(0)).alias("event_count"),
        F.coalesce(of("performance_available", "sample_size"), F.lit(0)).alias("labeled_count"),
        of("performance_available", "metric_value").alias("available"),
        F.coalesce(
            F.max_by(F.when(psi, F.col("severity")), F.when(psi, rank)),
            F.lit("insufficient_data"),
        ).alias("overall_drift_status"),
    )
    status = (
        F.when(F.col("event_count") < config.minimum_events, "insufficient_data")
        .when(F.coalesce(F.col("available"), F.lit(0.0)) < 1.0, "insufficient_labeled_data")
        .otherwise("completed")
    )
    return wide.select(
        F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).alias("window_start"),
        F.lit(end.strftime("%Y-%m-%d %H:%M:%S")).alias("window_end"),
        F.lit(config.version).alias("reference_version"),
        "event_count",
        "labeled_count",
        status.alias("status"),
        "overall_drift_status",
    )


def latest_state(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """The gauges of the newest run: one-hot status, counts, PSI and severity per feature,
    rates and performance; a value that is unavailable has no row.

    A failed newest run clears everything but its status; the last success is the newest run
    that did not fail. Runs and their metrics share ``window_end``.
    """
    newest = runs.agg(
        F.max_by(F.struct("window_end", "status", "event_count", "labeled_count"), "window_end").alias("r"),
        F.max(F.when(F.col("status") != "failed", F.col("window_end"))).alias("ok"),
    )
    # One row; the scalar keeps the metric table's filter on its own scan.
    end = newest.select("r.window_end").scalar()
    empty = F.lit(None).cast("string")
    gauges = [
        ("run_status", F.col("r.status"), F.lit(1.0)),
        ("window_events", empty, F.col("r.event_count").cast("double")),
        ("labeled_events", empty, F.col("r.labeled_count").cast("double")),
        ("last_success", F.col("ok").cast("string"), F.lit(1.0)),
    ]
    head = newest.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(g).alias("gauge"), label.alias("label"), v.alias("value"))
                    for g, label, v in gauges
                ]
            )
        )
    )
    name = F.col("metric_name")
    rows = metrics.where(F.col("window_end") == end)
    values = rows.where(
        F.col("metric_value").isNotNull()
        & name.isin("feature_psi", "alert_rate", "mean_fraud_score", "performance_available", *PERFORMANCE_METRICS)
    ).select(name.alias("gauge"), F.col("feature_name").alias("label"), F.col("metric_value").alias("value"))
    severities = rows.where((name == "feature_psi") & F.col("severity").isin(*SEVERITY_ORDER)).select(
        F.lit("feature_drift_severity").alias("gauge"),
        F.concat_ws(":", "feature_name", "severity").alias("label"),
        F.lit(1.0).alias("value"),
    )
    return head.unionByName(values).unionByName(severities)
