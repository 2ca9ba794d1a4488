"""Operational series over a request log.

Each series is a windowed aggregate with few keys; anything that needs order (alerts,
staleness) runs over the aggregated points, whose number depends on time and not on traffic. Samples
of gauges come at any times, so they are ordered in slabs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.functions.exprs import le_bucket_of, status_class
from tollgate.operators.ordered import assign_slab, cut_points, slab_count
from tollgate.session import checkpointed

# Inclusive upper bounds of the latency and score buckets.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
SCORE_BOUNDS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.995, 1.0]

# Alert rules (limit, seconds the condition must hold).
ERROR_RATE_ALERT = (0.05, 300)
LATENCY_ALERT = (1.0, 300)
READINESS_HOLD = 60
TARGET_HOLD = 60
STALENESS_LIMIT, STALENESS_HOLD = 300, 120
DRIFT_HOLD = 300

WINDOW_SECONDS = 300
# Slabs of time, at least, in which the samples of gauges are put in order.
SLABS = 256


def in_windows(df: DataFrame, ts: str = "ts", length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Add ``window_start``."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.withColumn("_w", w).withColumn("window_start", F.col("_w.start")).drop("_w")


def _per_second(count: Column, seconds: int = WINDOW_SECONDS) -> Column:
    return count / F.lit(float(seconds))


def request_rate(log: DataFrame) -> DataFrame:
    """Requests per second by method, route and status class."""
    return (
        in_windows(log)
        .groupBy("window_start", "method", "route", status_class(F.col("status")).alias("status_class"))
        .agg(_per_second(F.count(F.lit(1))).alias("rate"))
    )


def error_rate(log: DataFrame) -> DataFrame:
    """L2: share of 5xx responses; the denominator is at least 1e-6 per second."""
    failed = F.count_if(status_class(F.col("status")) == "5xx")
    return (
        in_windows(log)
        .groupBy("window_start")
        .agg(
            (
                _per_second(failed) / F.greatest(_per_second(F.count(F.lit(1))), F.lit(1e-6))
            ).alias("error_rate")
        )
    )


def bucket_quantile(q: float, bounds: Sequence[float], cumulative: Sequence[Column], total: Column) -> Column:
    """Quantile from cumulative bucket counts, linear inside a bucket; above the last bound
    the last bound is the answer."""
    rank = F.lit(float(q)) * total
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = float(bounds[i - 1]) if i else 0.0
        before = cumulative[i - 1] if i else F.lit(0)
        inside = cumulative[i] - before
        share = F.coalesce(F.try_divide(rank - before, inside), F.lit(1.0))
        value = F.lit(low) + F.lit(float(bounds[i]) - low) * share
        out = F.when(cumulative[i] >= rank, value).otherwise(out)
    return out


def latency_quantiles(log: DataFrame, quantiles: Sequence[float] = (0.50, 0.95, 0.99)) -> DataFrame:
    """L3: latency quantiles per route from fixed buckets; negative durations count as 0."""
    duration = F.greatest(F.col("duration_seconds"), F.lit(0.0))
    counted = (
        in_windows(log)
        .groupBy("window_start", "route")
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(duration <= b).alias(f"le{i}") for i, b in enumerate(LATENCY_BOUNDS)],
        )
    )
    les = [F.col(f"le{i}") for i in range(len(LATENCY_BOUNDS))]
    return counted.select(
        "window_start",
        "route",
        *[
            bucket_quantile(q, LATENCY_BOUNDS, les, F.col("total")).alias(f"p{round(q * 100)}")
            for q in quantiles
        ],
    )


def high_risk_rate(events: DataFrame, ts: str = "created_at") -> DataFrame:
    """L4: high-risk predictions per second; windows without any give 0."""
    return (
        in_windows(events, ts)
        .groupBy("window_start")
        .agg(_per_second(F.count_if(F.col("risk_level") == "high")).alias("rate"))
    )


def prediction_rate(events: DataFrame, key: str, ts: str = "created_at") -> DataFrame:
    """Predictions per second by risk level or by transaction type."""
    return (
        in_windows(events, ts)
        .groupBy("window_start", key)
        .agg(_per_second(F.count(F.lit(1))).alias("rate"))
    )


def score_buckets(events: DataFrame, ts: str = "created_at", length: str = "5 minutes") -> DataFrame:
    """Cumulative score buckets per window, +Inf included: one wide row per window, then long."""
    counted = (
        in_windows(events, ts, length)
        .groupBy("window_start", le_bucket_of(F.col("fraud_score"), SCORE_BOUNDS).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("window_start")
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("b") <= i, F.col("n"))), F.lit(0)).alias(f"le{i}")
                for i in range(len(SCORE_BOUNDS) + 1)
            ]
        )
    )
    names = [str(b) for b in SCORE_BOUNDS] + ["+Inf"]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("le"), F.col(f"le{i}").alias("cumulative_count"))
            for i, n in enumerate(names)
        ]
    )
    return counted.select("window_start", F.inline(rows))


def prediction_counters(classified: DataFrame) -> DataFrame:
    """Predictions by outcome, level, type and model version from new requests only, next to
    counts of replays and conflicts. ``classified`` has I2's ``status``."""
    keys = ["prediction", "risk_level", "transaction_type", "model_version"]
    counted = classified.groupBy("status", *keys).agg(F.count(F.lit(1)).alias("n"))
    fresh = counted.where(F.col("status") == "new").select(
        F.lit("predictions_total").alias("counter"),
        *[F.col(k).cast("string").alias(k) for k in keys],
        F.col("n").alias("row_count"),
    )
    names = {"replay": "idempotent_replays_total", "conflict": "idempotency_conflicts_total"}
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    rest = (
        counted.where(F.col("status").isin(*names))
        .groupBy(F.create_map(*pairs)[F.col("status")].alias("counter"))
        .agg(F.sum("n").alias("row_count"))
        .select("counter", *[F.lit(None).cast("string").alias(k) for k in keys], "row_count")
    )
    return fresh.unionByName(rest)


def sustained(
    points: DataFrame,
    condition: Column,
    hold_seconds: int,
    step_seconds: int = WINDOW_SECONDS,
    by: Sequence[str] = (),
    ts: str = "window_start",
) -> DataFrame:
    """Stretches of evenly spaced points where a condition holds for at least ``hold_seconds``.

    A missing point ends a stretch. ``points`` are aggregated series (one row per time step).
    """
    by = list(by)
    true = points.where(condition).select(*by, F.col(ts).alias("t"))
    # One series holds at most one row per time step: about 100,000 for a year of 5 minutes.
    order = Window.partitionBy(*by).orderBy("t")
    step = F.expr(f"INTERVAL '{step_seconds}' SECOND")
    starts = F.coalesce((F.col("t") - F.lag("t").over(order)) != step, F.lit(True))
    island = F.sum(F.col("_s").cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hold = F.expr(f"INTERVAL '{hold_seconds}' SECOND")
    return (
        true.withColumn("_s", starts)
        .withColumn("_island", island)
        .groupBy(*by, "_island")
        .agg(
            F.min("t").alias("pending_since"),
            F.max("t").alias("last_true"),
            F.count(F.lit(1)).alias("points"),
        )
        .where((F.col("points") - 1) * step_seconds >= hold_seconds)
        .withColumn("firing_since", F.col("pending_since") + hold)
        .drop("_island")
    )


def operational_alerts(log: DataFrame) -> DataFrame:
    """L9 for the error-rate and p95-latency rules."""
    rate_limit, rate_hold = ERROR_RATE_ALERT
    slow_limit, slow_hold = LATENCY_ALERT
    errors = error_rate(log).select(
        "window_start",
        F.lit("high_error_rate").alias("alert"),
        (F.col("error_rate") > rate_limit).alias("bad"),
    )
    slow = (
        latency_quantiles(log, [0.95])
        .groupBy("window_start")
        .agg(F.max("p95").alias("p95"))
        .select(
            "window_start",
            F.lit("high_p95_latency").alias("alert"),
            (F.col("p95") > slow_limit).alias("bad"),
        )
    )
    if rate_hold != slow_hold:
        raise ValueError("both rules share one hold time")
    return sustained(errors.unionByName(slow), F.col("bad"), rate_hold, by=["alert"])


def _seconds(moment: Column, kind: str) -> Column:
    """Seconds since 1970 as a double, from the difference of two instants of one type: the session zone
    plays no part, so the seconds never run back."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") if kind == "timestamp_ntz" else F.lit("1970-01-01 00:00:00+00:00").cast("timestamp")
    since = moment - zero
    parts = {"DAY": 86_400, "HOUR": 3_600, "MINUTE": 60, "SECOND": 1}
    return sum((F.extract(F.lit(p), since).cast("double") * n for p, n in parts.items()), F.lit(0.0))


def moment_cuts(samples: DataFrame, ts: str = "ts") -> list[float]:
    """Times, in seconds, that cut samples into slabs of about the same size."""
    at = samples.select(_seconds(F.col(ts), samples.schema[ts].dataType.simpleString()).alias("_at"))
    return cut_points(at, "_at", max(SLABS, slab_count(samples)))


def gauge_intervals(
    samples: DataFrame,
    condition: Column,
    hold_seconds: int,
    stale_seconds: int = STALENESS_LIMIT,
    by: Sequence[str] = (),
    ts: str = "ts",
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """L9 for gauges: stretches over which a condition on a gauge's last value holds for
    ``hold_seconds`` at least.

    ``samples`` come at any times. A sample counts until the next one, but no longer than
    ``stale_seconds``: after that the gauge has no value, which holds for nothing. Samples of one
    instant count as true if all are; those without a time do not count. One row per stretch:
    pending_since, firing_since, and ended_at, when the value changed or went stale.

    One gauge may hold all samples, so they are ordered slab by slab. A slab needs only the first moment of the next
    one and the last moment of the one before; stretches at its ends are put together afterwards, from two
    rows a slab. ``cuts`` only balance the work: any give the same stretches.
    """
    by = list(by)
    kind = samples.schema[ts].dataType.simpleString()
    cuts = moment_cuts(samples, ts) if cuts is None else cuts
    stale = F.expr(f"INTERVAL '{stale_seconds}' SECOND")
    hold = F.expr(f"INTERVAL '{hold_seconds}' SECOND")
    moments = (
        samples.where(F.col(ts).isNotNull())
        .groupBy(*by, F.col(ts).alias("t"))
        .agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("_true"))
    )
    moments = assign_slab(moments.withColumn("_at", _seconds(F.col("t"), kind)), "_at", cuts).drop("_at")
    # read for the edges and for the rows
    moments = checkpointed(moments)
    # one row per series and slab
    series = Window.partitionBy(*by).orderBy("_slab")
    edges = (
        moments.groupBy(*by, "_slab")
        .agg(F.min("t").alias("_first"), F.max(F.struct("t", "_true")).alias("_last"))
        .select(*by, "_slab", F.lead("_first").over(series).alias("_after"), F.lag("_last").over(series).alias("_before"))
    )
    edges = edges.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slab").alias("_by_slab"), "_after", "_before")
    same = F.col("_slab") == F.col("_by_slab")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    order = Window.partitionBy(*by, "_slab").orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.least(F.coalesce(F.lead("t").over(order), F.col("_after"), F.col("t") + stale), F.col("t") + stale)
    # a stretch goes on where the sample before was true and counted up to this one
    before_t = F.coalesce(F.lag("t").over(order), F.col("_before.t"))
    before_true = F.coalesce(F.lag("_true").over(order), F.col("_before._true"))
    goes_on = F.coalesce(before_true & (F.col("t") <= before_t + stale), F.lit(False))
    # part 0 of a slab goes on with a stretch of the slab before
    parts = (
        moments.join(edges, same, "left")
        .withColumn("_until", until)
        .withColumn("_starts", (F.col("_true") & ~goes_on).cast("int"))
        .withColumn("_part", F.sum("_starts").over(upto))
        .where("_true")
        .groupBy(*by, "_slab", "_part")
        .agg(F.min("t").alias("pending_since"), F.max("_until").alias("ended_at"))
    )
    # a stretch can only go on from the last part of a slab
    last = F.max("_part").over(Window.partitionBy(*by, "_slab"))
    parts = parts.withColumn("_edge", (F.col("_part") == 0) | (F.col("_part") == last))
    stretch = F.sum((F.col("_part") > 0).cast("int")).over(
        Window.partitionBy(*by).orderBy("_slab", "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = (
        parts.where("_edge")
        .withColumn("_stretch", stretch)
        .groupBy(*by, "_stretch")
        .agg(F.min("pending_since").alias("pending_since"), F.max("ended_at").alias("ended_at"))
    )
    fields = [*by, "pending_since", "ended_at"]
    return (
        parts.where("NOT _edge")
        .select(*fields)
        .unionByName(joined.select(*fields))
        .where(F.col("ended_at") - F.col("pending_since") >= hold)
        .select(*by, "pending_since", (F.col("pending_since") + hold).alias("firing_since"), "ended_at")
    )


def gauge_alerts(gauges: DataFrame) -> DataFrame:
    """L9 for the rules on gauges (gauge, instance, ts, value): not ready and target down for a
    minute, significant drift (value 2 of ``drift_severity``) for five."""
    rules = {
        "not_ready": ("ready", F.col("value") == 0, READINESS_HOLD),
        "target_down": ("up", F.col("value") == 0, TARGET_HOLD),
        "significant_drift": ("drift_severity", F.col("value") == 2, DRIFT_HOLD),
    }
    found, cuts = None, moment_cuts(gauges)
    for alert, (gauge, condition, hold) in rules.items():
        part = gauge_intervals(gauges.where(F.col("gauge") == gauge), condition, hold, by=["instance"], cuts=cuts)
        part = part.select(F.lit(alert).alias("alert"), "instance", "pending_since", "firing_since", "ended_at")
        found = part if found is None else found.unionByName(part)
    return found


def stale_intervals(
    log: DataFrame,
    ok: Column,
    by: Sequence[str],
    limit_seconds: int = STALENESS_LIMIT,
    hold_seconds: int = STALENESS_HOLD,
    ts: str = "ts",
) -> DataFrame:
    """Spans without a success so long that the staleness alert fired.

    A span runs from one success to the next. One that has not ended when the log ends has no
    ``resolved_at``; before the first success a series counts as stale since its first entry, with
    no ``last_success``. A series without any success gives one row with neither.

    Entries are folded to a few instants per minute, so order is needed only over minutes. A gap
    inside one minute can never reach the limit.
    """
    by = list(by)
    if limit_seconds < 60:
        raise ValueError("the limit must be at least one minute")
    minutes = log.groupBy(*by, F.window(ts, "1 minute").alias("_w")).agg(
        F.min(ts).alias("first_any"),
        F.max(ts).alias("last_any"),
        F.min(F.when(ok, F.col(ts))).alias("first_ok"),
        F.max(F.when(ok, F.col(ts))).alias("last_ok"),
    )
    before = (
        Window.partitionBy(*by).orderBy("first_any").rowsBetween(Window.unboundedPreceding, -1)
    )
    ended = (
        minutes.withColumn("last_success", F.max("last_ok").over(before))
        .withColumn("_seen", F.coalesce(F.min("first_any").over(before), F.col("first_any")))
        .where(F.col("first_ok").isNotNull())
        .select(*by, "last_success", "_seen", F.col("first_ok").alias("resolved_at"))
    )
    end = minutes.agg(F.max("last_any")).scalar()
    still_open = (
        minutes.groupBy(*by)
        .agg(F.max("last_ok").alias("last_success"), F.min("first_any").alias("_seen"))
        .withColumn("resolved_at", F.lit(None).cast(log.schema[ts].dataType))
    )
    gap = F.expr(f"INTERVAL '{limit_seconds + hold_seconds}' SECOND")
    since = F.coalesce("last_success", "_seen")
    return (
        ended.unionByName(still_open)
        .where(F.coalesce(F.col("resolved_at"), end) - since > gap)
        .select(*by, "last_success", (since + gap).alias("firing_since"), "resolved_at")
    )


def request_fields(events: DataFrame) -> DataFrame:
    """Batch size, predictions and high-risk predictions per request."""
    return events.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.count("prediction").alias("prediction_count"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_prediction_count"),
    )
