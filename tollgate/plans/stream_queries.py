"""Registered queries of the streaming operators (K1-K4, K6-K9).

The given rows arrive in a few portions. After each one the stream runs over what is new and stops, so
every query also goes through restarts from its checkpoint. What it wrote is read back as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tollgate.functions.exprs import logistic_score
from tollgate.operators.series import ERROR_RATE_ALERT
from tollgate.plans.core_queries import FEATURES_CTE, WINDOW_END
from tollgate.plans.model_queries import FROZEN, FROZEN_INTERCEPT
from tollgate.plans.ops_queries import (
    _ADMIT,
    _LATENCY,
    _METRICS_NOW,
    _MINUTES,
    _metrics_sql,
    _profile,
    _quantile_sql,
    stamped,
)
from tollgate.plans.registry import query, rounded, txn
from tollgate.session import shared_folder
from tollgate.sources import canonical
from tollgate.sources.batches import BatchTable
from tollgate.streaming import intake, late, monitor, scoring, states

#: Hours of the given month in one portion.
PORTION = 240


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def arriving(rows: DataFrame, portion: Column, portions: int, *steps: Callable[[], DataStreamWriter], path: str) -> None:
    """Append the portions of ``rows`` to a folder one by one, and run the steps over each."""
    for n in range(portions):
        rows.where(portion == n).write.mode("append").parquet(path)
        for step in steps:
            run = step().trigger(availableNow=True).start()
            run.awaitTermination()
            if run.exception():
                raise run.exception()


def files(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def into(stream: DataFrame, path: str) -> DataStreamWriter:
    return stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")


def each(stream: DataFrame, path: str, fn: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", f"{path}/state")


def by_hour() -> Column:
    return F.least(F.floor((F.col("step") - 1) / PORTION), F.lit(2))


@query(
    "k1_stream_scores",
    FEATURES_CTE
    + ", s AS (SELECT txn_id, 1/(1+exp(-("
    + str(FROZEN_INTERCEPT)
    + "".join(f" + {w}*(({n}-{m})/{s})" for n, (m, s, w) in FROZEN.items())
    + """))) AS score FROM feats)
       SELECT CAST(txn_id AS VARCHAR) AS request_id, 0 AS item_index, round(score, 5) AS fraud_score, CASE WHEN score >= 0.98310834 THEN 1 ELSE 0 END AS prediction,
         CASE WHEN score >= 0.98310834 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level FROM s""",
)
def k1(spark: SparkSession, d: str) -> DataFrame:
    items = F.struct("step", "type", "amount", "oldbalanceOrg", "oldbalanceDest")
    asked = txn(spark, d).select("step", F.col("txn_id").cast("string").alias("request_id"), F.array(items).alias("transactions"))
    means, scales, weights = zip(*FROZEN.values())
    score = logistic_score(list(FROZEN), means, scales, weights, FROZEN_INTERCEPT)
    path = folder(spark)
    stream = lambda: into(scoring.score_rows(scoring.request_items(files(spark, f"{path}/in", asked.schema).drop("step")), score), path)
    arriving(asked, by_hour(), 3, stream, path=f"{path}/in")
    made = spark.read.parquet(f"{path}/data")
    return rounded(made.select("request_id", "item_index", "fraud_score", "prediction", "risk_level"), 5)


@query(
    "k2_stream_intake",
    """+ f AS (SELECT request_id, arg_min(amount, attempt) AS a0, min(attempt) AS t0 FROM attempts GROUP BY request_id)
       SELECT CAST(a.request_id AS VARCHAR) AS request_id, CAST(a.attempt AS BIGINT) AS attempt,
         CASE WHEN a.amount <> f.a0 THEN 'conflict' WHEN a.attempt = f.t0 THEN 'new' ELSE 'replay' END AS status
       FROM attempts a JOIN f ON a.request_id = f.request_id""",
)
def k2(spark: SparkSession, d: str) -> DataFrame:
    sent = canonical.intake_attempts(txn(spark, d)).select(
        F.col("request_id").cast("string").alias("request_id"),
        F.col("attempt").cast("bigint").alias("attempt"),
        F.sha2(F.col("amount").cast("string"), 256).alias("payload_hash"),
    )
    path = folder(spark)
    table = BatchTable(spark, f"{path}/ledger", intake.INTAKE_SCHEMA, key="request_id", buckets=8)
    stream = lambda: each(files(spark, f"{path}/in", sent.schema), path, intake.intake_writer(table))
    arriving(sent, F.col("attempt") - 1, 3, stream, path=f"{path}/in")
    return table.read().select("request_id", "attempt", "status")


@query(
    "k3_stream_labels",
    """SELECT p.prediction_id, p.prediction, o.actual_fraud, strftime(o.observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at
       FROM predictions p JOIN outcomes o ON o.prediction_id = p.prediction_id""",
)
def k3(spark: SparkSession, d: str) -> DataFrame:
    """Labels join their events as they arrive, up to two days late."""
    rows = txn(spark, d)
    events = canonical.predictions(rows).select("prediction_id", "prediction", "step", F.col("created_at").cast("timestamp").alias("created_at"))
    labels = canonical.outcomes(rows).select("prediction_id", "actual_fraud", F.col("observed_at").cast("timestamp").alias("observed_at"))
    hour = F.floor((F.unix_timestamp("observed_at") - F.lit(int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()))) / 3600)
    portion = F.least(F.floor(hour / PORTION), F.lit(2))
    path = folder(spark)
    both = lambda: into(
        intake.label_join(files(spark, f"{path}/in", events.schema), files(spark, f"{path}/labels", labels.schema), "48 hours", "1 hour"), path
    )
    for n in range(3):
        labels.where(portion == n).write.parquet(f"{path}/labels/portion={n}")
        arriving(events.where(by_hour() == n), F.lit(0), 1, both, path=f"{path}/in")
    made = spark.read.parquet(f"{path}/data").where("actual_fraud IS NOT NULL")
    return stamped(made.select("prediction_id", "prediction", "actual_fraud", "observed_at"))


@query("k4_label_conflicts", _ADMIT + "SELECT * FROM adm")
def k4(spark: SparkSession, d: str) -> DataFrame:
    return admitted_by_stream(spark, txn(spark, d))[0]


def admitted_by_stream(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts and merged labels of the label batches, which arrive in three portions."""
    intake.use_rocksdb(spark)
    sent = canonical.outcome_submissions(rows)
    events, before = canonical.predictions(rows).select("prediction_id"), canonical.stored_outcomes(rows)
    last = sent.agg(F.max("batch_id")).first()[0] or 0
    path = folder(spark)
    tables = {
        "labels": "batch_id bigint, position bigint, prediction_id bigint, actual_fraud int, source string",
        "verdicts": "batch_id bigint, submissions bigint, unknown_ids bigint, label_conflicts bigint, stored_conflicts bigint, earlier_conflicts bigint, oversize boolean, admitted boolean",
        "merged": "batch_id bigint, position bigint, prediction_id bigint, actual_fraud int, source string, replayed boolean",
    }
    keys = {"labels": "prediction_id"}
    kept = {name: BatchTable(spark, f"{path}/{name}", spark.createDataFrame([], schema).schema, key=keys.get(name), buckets=8) for name, schema in tables.items()}
    write = states.label_writer(lambda: events, before, kept["labels"], kept["verdicts"], kept["merged"])
    stream = lambda: each(states.claimed_labels(files(spark, f"{path}/in", sent.schema)), path, write)
    arriving(sent, F.least(F.floor(F.col("batch_id") * 3 / (last + 1)), F.lit(2)), 3, stream, path=f"{path}/in")
    return kept["verdicts"].read(), kept["merged"].read()


# A minute is closed once the watermark, ten minutes behind the newest event, has passed its end.
_CLOSED = "SELECT max(ts) - INTERVAL 10 MINUTE FROM txn"


@query(
    "k6_stream_windows",
    _MINUTES
    + f""", cm AS (SELECT * FROM mt WHERE minute + INTERVAL 1 MINUTE <= ({_CLOSED})),
       we AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 6 HOUR)) AS window_end)
       SELECT cm.series, cm.bucket, strftime(we.window_end, '%Y-%m-%d %H:%M:%S') AS window_end, CAST(sum(cm.n) AS BIGINT) AS n, round(sum(cm.total), 4) AS total
       FROM cm JOIN we ON cm.minute >= we.window_end - INTERVAL 24 HOUR AND cm.minute < we.window_end
       WHERE we.window_end <= (SELECT max(minute) FROM cm) GROUP BY 1, 2, 3""",
)
def k6_stream(spark: SparkSession, d: str) -> DataFrame:
    """Minutes close in one stream, windows over them in a second one."""
    intake.use_rocksdb(spark)
    rows = txn(spark, d)
    profile = _profile(rows)
    events = canonical.predictions(rows).withColumn("created_at", F.col("created_at").cast("timestamp"))
    path = folder(spark)
    minutes = "minute timestamp, series string, bucket string, n bigint, total double"
    first = int(datetime(2024, 1, 2, tzinfo=timezone.utc).timestamp() * 1000)
    close = lambda: into(monitor.minute_stream(files(spark, f"{path}/in", events.schema), profile), f"{path}/minutes")
    ring = lambda: into(states.trailing_stream(files(spark, f"{path}/minutes/data", minutes), 86_400, 21_600, first), f"{path}/windows")
    arriving(events, by_hour(), 3, close, ring, path=f"{path}/in")
    made = spark.read.parquet(f"{path}/windows/data")
    return stamped(made.withColumn("total", F.round(F.col("total").cast("double"), 4) + F.lit(0.0)))


@query("k7_monitoring_per_trigger", _METRICS_NOW + _metrics_sql("now", "before"))
def k7(spark: SparkSession, d: str) -> DataFrame:
    """Every portion triggers a run of the same window, which then stands once."""
    rows = txn(spark, d)
    path = folder(spark)
    write = monitor.monitoring_writer(lambda: canonical.predictions(rows), lambda: canonical.outcomes(rows), _profile(rows), path, clock=lambda: WINDOW_END)
    ticks = rows.select("txn_id", "step").where("txn_id % 100 = 0")
    stream = lambda: each(files(spark, f"{path}/in", ticks.schema), path, write)
    arriving(ticks, F.least(F.floor((F.col("step") - 1) / 360), F.lit(1)), 2, stream, path=f"{path}/in")
    return rounded(monitor.read_runs(spark, path)[1].drop("run_id"))


# One event in ten arrives 400 hours late, the others up to two days.
_ARRIVAL = "least(4, (step + CASE WHEN txn_id % 10 = 0 THEN 400 ELSE txn_id % 48 END) {div} 192)"
LATE_SECONDS = 86_400


@query(
    "k8_late_rows",
    f"""+ a AS (SELECT txn_id, ts, {_ARRIVAL.format(div="//")} AS portion FROM txn),
       h AS (SELECT portion, max(ts) AS high FROM a GROUP BY portion),
       l AS (SELECT a.*, coalesce(ts <= (SELECT max(high) FROM h WHERE h.portion <= a.portion - 2) - INTERVAL {LATE_SECONDS} SECOND, FALSE) AS late FROM a)
       SELECT CAST(portion AS BIGINT) AS portion, late, count(*) AS row_count, CAST(sum(txn_id) AS BIGINT) AS id_sum FROM l GROUP BY 1, 2""",
)
def k8(spark: SparkSession, d: str) -> DataFrame:
    """Rows in time and late ones of every micro-batch."""
    rows = txn(spark, d).select("txn_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(_ARRIVAL.format(div="div")).cast("bigint").alias("portion"))
    path = folder(spark)
    kept = {name: BatchTable(spark, f"{path}/{name}", rows.schema) for name in ("in_time", "late")}
    marks = BatchTable(spark, f"{path}/marks", late.MARK_SCHEMA)
    write = late.late_splitter(kept["in_time"].write, kept["late"], marks, LATE_SECONDS, "ts")
    stream = lambda: each(files(spark, f"{path}/in", rows.schema), path, write)
    arriving(rows, F.col("portion"), 5, stream, path=f"{path}/in")
    both = kept["in_time"].read().withColumn("late", F.lit(False)).union(kept["late"].read().withColumn("late", F.lit(True)))
    return both.groupBy("portion", "late").agg(F.count("*").alias("row_count"), F.sum("txn_id").alias("id_sum"))


@query(
    "k9_stream_alerts",
    _LATENCY
    + f""", er AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, count(*) FILTER (WHERE status >= 500)/CAST(count(*) AS DOUBLE) AS v FROM log GROUP BY 1),
       cw AS (SELECT w FROM er WHERE w + INTERVAL 5 MINUTE <= ({_CLOSED})),
       pts AS (SELECT 'high_error_rate' AS alert, w FROM er WHERE v > {ERROR_RATE_ALERT[0]}
               UNION ALL SELECT 'high_p95_latency', w FROM (SELECT w, max({_quantile_sql(0.95)}) AS m FROM lb GROUP BY w) WHERE m > 1),
       isl AS (SELECT alert, w, w - to_minutes(CAST(5*row_number() OVER (PARTITION BY alert ORDER BY w) AS INTEGER)) AS g FROM pts WHERE w IN (SELECT w FROM cw)),
       grp AS (SELECT alert, min(w) AS lo, max(w) AS hi, count(*) AS points, max(w) + INTERVAL 5 MINUTE <= (SELECT max(w) FROM cw) AS over FROM isl GROUP BY alert, g HAVING count(*) >= 2)
       SELECT alert, strftime(lo, '%Y-%m-%d %H:%M:%S') AS pending_since, strftime(lo + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS firing_since,
              CASE WHEN over THEN strftime(hi, '%Y-%m-%d %H:%M:%S') END AS last_true, CASE WHEN over THEN points END AS points FROM grp""",
)
def k9(spark: SparkSession, d: str) -> DataFrame:
    """Windows close in one stream, alerts change state in a second one."""
    intake.use_rocksdb(spark)
    log = canonical.request_log(txn(spark, d)).withColumn("ts", F.col("ts").cast("timestamp"))
    log = log.withColumn("step", F.floor((F.unix_timestamp("ts") - F.lit(int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()))) / 3600) + 1)
    path = folder(spark)
    points = lambda: into(states.alert_points_stream(files(spark, f"{path}/in", log.schema)), f"{path}/points")
    kind = "window_start timestamp, alert string, bad boolean"
    alerts = lambda: into(states.alert_stream(files(spark, f"{path}/points/data", kind), ERROR_RATE_ALERT[1]), f"{path}/alerts")
    arriving(log, by_hour(), 3, points, alerts, path=f"{path}/in")
    made = spark.read.schema(states.ALERT_SCHEMA).parquet(f"{path}/alerts/data")
    fired = made.where("status = 'firing'").select("alert", "pending_since", F.col("at").alias("firing_since"))
    over = made.where("status = 'resolved'").select("alert", "pending_since", "last_true", "points")
    return stamped(fired.join(over, ["alert", "pending_since"], "left"))
