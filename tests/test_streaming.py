"""Streams give what the same operators give on the whole input at once."""

import tempfile
import time
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tollgate.functions.exprs import logistic_score
from tollgate.operators import drift, ledger, trailing
from tollgate.operators.evaluate import check_scores
from tollgate.plans import stream_queries
from tollgate.plans.core_queries import train_of
from tollgate.schemas import MONITORING_RUN_SCHEMA, OUTCOME_SCHEMA
from tollgate.sources import canonical
from tollgate.sources.batches import BatchTable
from tollgate.sources.streams import clean_outcomes, file_stream, request_stream
from tollgate.streaming import intake, late, monitor, scoring, states


def scratch() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def drain(query):
    query.awaitTermination(240)
    if query.exception():
        raise query.exception()
    return query


def start(df, path, mode="append"):
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/_checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start(f"{path}/data")
    )


def start_batches(df, path, fn):
    return (
        df.writeStream.foreachBatch(fn)
        .option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def txn(spark, small_dir):
    return canonical.transactions(spark, small_dir)


@pytest.fixture(scope="module")
def events(txn):
    preds = canonical.predictions(txn)
    return preds.withColumn("created_at", F.col("created_at").cast("timestamp"))


def test_scoring_stream_equals_batch(spark, txn):
    src, out = scratch(), scratch()
    items = F.struct("step", "type", "amount", "oldbalanceOrg", "oldbalanceDest")
    bad = F.when(F.col("txn_id") % 50 == 0, "WIRE").otherwise(F.col("type"))
    asked = (
        txn.withColumn("type", bad)
        .select(
            F.col("txn_id").cast("string").alias("request_id"),
            F.lit("/predict").alias("endpoint"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.array(items).alias("transactions"),
        )
        .repartition(3)
    )
    asked.write.mode("overwrite").json(src)
    score = logistic_score(["log_amount"], [4.0], [1.5], [0.8], -1.0)
    stream = scoring.score_rows(
        scoring.request_items(request_stream(spark, src, maxFilesPerTrigger="1")), score
    )
    drain(start(stream, out))
    whole = scoring.score_rows(scoring.request_items(asked), score)
    wanted = ("request_id", "item_index", "fraud_score", "prediction", "risk_level")
    assert rows(spark.read.parquet(f"{out}/data"), *wanted[:2]) == rows(whole, *wanted[:2])
    key = lambda t: (t[0], t[1])
    got = sorted((tuple(r) for r in spark.read.parquet(f"{out}/data").select(*wanted).collect()), key=key)
    want = sorted((tuple(r) for r in whole.select(*wanted).collect()), key=key)
    assert got == want
    refused = whole.where(F.size("reject_reasons") > 0)
    assert refused.count() == 20 and refused.where("fraud_score IS NOT NULL").count() == 0


def attempts_as_files(txn):
    src = scratch()
    attempts = canonical.intake_attempts(txn).select(
        F.col("request_id").cast("string").alias("request_id"),
        F.col("attempt").cast("bigint").alias("attempt"),
        F.sha2(F.col("amount").cast("string"), 256).alias("payload_hash"),
    )
    for n in (1, 2, 3):
        attempts.where(F.col("attempt") == n).coalesce(1).write.mode("append").parquet(src)
    return src, attempts


def test_intake_stream_equals_batch_and_survives_a_retry(spark, txn):
    src, attempts = attempts_as_files(txn)
    out = scratch()
    table = BatchTable(spark, f"{out}/intake", intake.INTAKE_SCHEMA)
    stream = file_stream(spark, src, attempts.schema, "parquet", maxFilesPerTrigger="1", latestFirst="false")
    write = intake.intake_writer(table)
    drain(start_batches(stream, out, write))
    want = rows(ledger.classify_attempts(attempts), "request_id", "attempt", "status")
    assert rows(table.read(), "request_id", "attempt", "status") == want
    # The last batch runs again, as after a lost driver.
    write(attempts.where("attempt = 3"), 2)
    assert rows(table.read(), "request_id", "attempt", "status") == want


def test_keyed_state_equals_batch(spark, txn):
    src, attempts = attempts_as_files(txn)
    out = scratch()
    intake.use_rocksdb(spark)
    stream = file_stream(spark, src, attempts.schema, "parquet", maxFilesPerTrigger="1", latestFirst="false")
    drain(start(intake.classify_with_state(stream), out))
    want = rows(ledger.classify_attempts(attempts), "request_id", "attempt", "status")
    assert rows(spark.read.parquet(f"{out}/data"), "request_id", "attempt", "status") == want


def test_distinct_items_stream(spark, events):
    src, out = scratch(), scratch()
    doubled = events.union(events.where("prediction_id % 3 = 0"))
    doubled.coalesce(1).write.mode("overwrite").parquet(src)
    stream = intake.distinct_items(file_stream(spark, src, doubled.schema, "parquet"))
    drain(start(stream, out))
    assert spark.read.parquet(f"{out}/data").count() == events.count()


def label_rows(spark, data):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return spark.createDataFrame(
        [(b, p, i, y, at, s) for b, p, i, y, s in data], OUTCOME_SCHEMA
    )


def test_outcome_stream_merges_and_refuses(spark):
    out = scratch()
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "prediction_id string")
    labels = BatchTable(spark, f"{out}/labels", intake.LABEL_SCHEMA)
    refusals = BatchTable(spark, f"{out}/refusals", intake.REFUSAL_SCHEMA)
    write = intake.outcome_writer(lambda: known, labels, refusals)
    write(label_rows(spark, [("1", 1, "a", 1, "x"), ("1", 2, "a", 1, "y"), ("1", 3, "b", 0, "x")]), 0)
    assert rows(labels.read(), "prediction_id", "actual_fraud", "source") == [("a", 1, "x"), ("b", 0, "x")]
    write(label_rows(spark, [("2", 1, "c", 1, "x"), ("2", 2, "zz", 1, "x"), ("3", 3, "a", 0, "x"), ("4", 4, "a", 1, "z")]), 1)
    assert labels.read().count() == 2
    got = rows(refusals.read(), "batch_id", "unknown_ids", "label_conflicts", "stored_conflicts")
    # Batch 4 repeats the stored label; that refused batch 3 says otherwise does not matter.
    assert got == [("2", 1, 0, 0), ("3", 0, 0, 1)]
    write(label_rows(spark, [("5", 1, "c", 1, "x")]), 2)
    assert labels.read().count() == 3


def test_clean_outcomes(spark):
    cleaned = clean_outcomes(
        label_rows(spark, [("1", 1, "a", 1, "  desk "), ("1", 2, "b", 2, "x"), ("1", 3, "c", 1, "  ")])
    )
    assert rows(cleaned, "prediction_id", "source", "valid") == [
        ("a", "desk", True), ("b", "x", False), ("c", "", False),
    ]


def test_label_join_stream(spark, txn, events):
    src, out = scratch(), scratch()
    labels = canonical.outcomes(txn).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    events.coalesce(1).write.mode("overwrite").parquet(f"{src}/e")
    labels.coalesce(1).write.mode("overwrite").parquet(f"{src}/l")
    joined = intake.label_join(
        file_stream(spark, f"{src}/e", events.schema, "parquet"),
        file_stream(spark, f"{src}/l", labels.schema, "parquet"),
        lateness="0 seconds",
    )
    drain(start(joined.select("prediction_id", "actual_fraud"), out))
    got = spark.read.parquet(f"{out}/data").where("actual_fraud IS NOT NULL")
    assert rows(got, "prediction_id", "actual_fraud") == rows(labels, "prediction_id", "actual_fraud")


def test_minute_stream_equals_batch_on_closed_minutes(spark, txn, events):
    src, out = scratch(), scratch()
    profile = drift.freeze_profile(train_of(txn))
    events.coalesce(1).write.mode("overwrite").parquet(src)
    stream = monitor.minute_stream(file_stream(spark, src, events.schema, "parquet"), profile)
    query = drain(start(stream, out))
    assert monitor.dropped_late_rows(query) == 0
    got = spark.read.parquet(f"{out}/data")
    end = got.agg(F.max("minute")).first()[0]
    whole = trailing.minute_totals(events, profile, F.date_trunc("minute", "created_at"))
    closed = whole.where(F.col("minute") <= F.lit(end))
    columns = ("minute", "series", "bucket", "n")
    assert got.count() > 5000
    assert rows(got, *columns) == rows(closed, *columns)


def test_rate_stream(spark, txn):
    src, out = scratch(), scratch()
    log = canonical.request_log(txn).withColumn("ts", F.col("ts").cast("timestamp"))
    log.coalesce(1).write.mode("overwrite").parquet(src)
    drain(start(monitor.rate_stream(file_stream(spark, src, log.schema, "parquet")), out))
    got = spark.read.parquet(f"{out}/data")
    # Each row counts in five one-minute slides, but for the windows still open at the end.
    total = got.agg(F.sum(F.col("rate") * 300)).first()[0]
    assert 0 < 5 * log.count() - total <= 5 * 10


def test_monitoring_run_is_idempotent_and_records_failures(spark, txn, events):
    out = scratch()
    profile = drift.freeze_profile(train_of(txn))
    config = drift.MonitoringConfig(minimum_events=5, minimum_labeled_events=5)
    labels = canonical.outcomes(txn)
    end = datetime(2024, 1, 31, tzinfo=timezone.utc)
    ticks = iter([end])
    write = monitor.monitoring_writer(
        lambda: events, lambda: labels, profile, out, config, clock=lambda: next(ticks)
    )
    write(None, 0)
    write(None, 0)  # tried again: the same window, whatever the clock says
    runs, metrics = monitor.read_runs(spark, out)
    assert [r["status"] for r in runs.collect()] == ["completed"]
    assert metrics.count() == 26
    negative = events.withColumn("amount", -F.col("amount") - 1)
    status = monitor.run_monitoring(
        negative, labels, profile, datetime(2024, 1, 30, tzinfo=timezone.utc), out, config
    )
    assert status == "failed"
    runs, metrics = monitor.read_runs(spark, out)
    assert runs.count() == 2 and metrics.count() == 26
    assert runs.schema.fieldNames() == MONITORING_RUN_SCHEMA.fieldNames()


def in_files(spark, batches, schema):
    """Every batch as one file; a stream that takes a file at a time sees them in this order."""
    src = scratch()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken by their time of writing
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def minute(n):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=n)


def test_late_rows_are_those_a_stateful_twin_drops(spark):
    times = [[0, 10, 20], [30, 5], [40, 19, 25, 9], [29, 35, 8, 10], [60], [39, 20, 49, 50, 51]]
    batches = [[(100 * b + n, minute(m)) for n, m in enumerate(ms)] for b, ms in enumerate(times)]
    stream = in_files(spark, batches, "id long, created_at timestamp")
    twin = scratch()
    query = drain(start(stream.withWatermark("created_at", "10 minutes").dropDuplicates(["id", "created_at"]), twin))
    out = scratch()
    kept = {n: BatchTable(spark, f"{out}/{n}", stream.schema) for n in ("in_time", "late")}
    marks = BatchTable(spark, f"{out}/marks", late.MARK_SCHEMA)
    write = late.late_splitter(kept["in_time"].write, kept["late"], marks, 600)
    drain(start_batches(stream, out, write))
    want = rows(spark.read.parquet(f"{twin}/data"), "id")
    assert rows(kept["in_time"].read(), "id") == want
    dropped = rows(kept["late"].read(), "id")
    assert len(dropped) == monitor.dropped_late_rows(query) > 0
    assert sorted(want + dropped) == sorted((i,) for b in batches for i, _ in b)
    # a batch that is tried again is split as before
    write(spark.createDataFrame(batches[3], stream.schema), 3)
    assert rows(kept["late"].read(), "id") == dropped and rows(kept["in_time"].read(), "id") == want


def test_label_stream_equals_batch_after_restarts(spark, txn):
    verdicts, merged = stream_queries.admitted_by_stream(spark, txn)
    sent, events, stored = canonical.outcome_submissions(txn), canonical.predictions(txn), canonical.stored_outcomes(txn)
    admitted = ledger.admit_batches(sent, events, stored)
    assert rows(verdicts, *verdicts.columns) == rows(admitted, *verdicts.columns)
    columns = ("batch_id", "position", "prediction_id", "actual_fraud", "source", "replayed")
    assert rows(merged, *columns) == rows(ledger.merge_outcomes(sent, admitted, stored), *columns)


def test_label_claims_are_kept_by_bucket(spark):
    """State and Python calls are as many as buckets, not as predictions."""
    intake.use_rocksdb(spark)
    schema = "batch_id bigint, position bigint, prediction_id bigint, actual_fraud int, source string"
    large = 2**62 + 1
    first = [(1, i, i, i % 2, "x") for i in range(3000)] + [(1, 3000, 7, 1, "x"), (1, 3001, large, 1, "x"), (1, 3002, None, None, "x")]
    second = [(2, 4000 + i, p, 0, "y") for i, p in enumerate((2999, 3000, large, large - 1, -5, None))]
    third = [(3, 5000 + i, p, 0, "z") for i, p in enumerate((3000, -5, -6, 0, large, None))]
    out = scratch()
    query = drain(start(states.claimed_labels(in_files(spark, [first, second, third], schema), buckets=16), out))
    assert {p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]} <= set(range(17))
    made = spark.read.parquet(f"{out}/data")
    assert made.where("claimed").select("batch_id", "position").orderBy("position").collect() == [(2, 4000), (2, 4002), (3, 5000), (3, 5001), (3, 5003), (3, 5004)]
    assert made.count() == 3015 and sorted(r["position"] for r in made.where("prediction_id IS NULL").collect()) == [3002, 4005, 5005]
    assert made.where("prediction_id = 7").count() == 2 and made.where(f"prediction_id = {large}").count() == 3


def test_label_claims_forget_by_prediction():
    class Kept:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Clock:
        def __init__(self, now):
            self.getCurrentProcessingTimeInMs = lambda: now

    claims = states.LabelClaims(100)
    claims.sent = Kept()

    def claimed(now, *ids):
        frame = pd.DataFrame({c: [0] * len(ids) for c in states.CLAIM_SCHEMA.fieldNames()[:-1]}).assign(prediction_id=ids)
        return [bool(v) for out in claims.handleInputRows((0,), iter([frame[:1], frame[1:]]), Clock(now)) for v in out["claimed"]]

    assert claimed(0, 5, 9, 5) == [False] * 3
    assert claimed(60, 9, 2) == [True, False]
    # 5 was last sent for 120 ms ago, 9 and 2 only 60
    assert claimed(120, 5, 9, 2) == [False, True, True]


def test_alerts_fire_and_end_without_further_input(spark):
    intake.use_rocksdb(spark)
    def points(name, bad):
        return [(minute(5 * n), name, b) for n, b in bad.items()]

    # one falls silent while it fires, one before; one ends by a false point, one misses a point
    first = points("silent", {0: True, 1: True}) + points("short", {0: True}) + points("ends", {0: False, 1: True})
    second = points("ends", {2: True, 3: True, 4: False}) + points("gap", {2: True, 4: True, 5: True})
    third = points("ends", {9: False})
    stream = in_files(spark, [first, second, third], "window_start timestamp, alert string, bad boolean")
    out = scratch()
    drain(start(states.alert_stream(stream, 300), out))
    got = spark.read.parquet(f"{out}/data").where("status <> 'pending'")
    of = [(r.alert, r.status, r.pending_since, r["at"], r.points) for r in got.collect()]
    local = lambda n: minute(n).astimezone().replace(tzinfo=None)
    assert sorted(of) == sorted(
        [
            ("silent", "firing", local(0), local(5), 2), ("silent", "resolved", local(0), local(10), 2),
            ("ends", "firing", local(5), local(10), 2), ("ends", "resolved", local(5), local(20), 3),
            ("gap", "firing", local(20), local(25), 2), ("gap", "resolved", local(20), local(30), 2),
        ]
    )


def test_windows_of_a_silent_series_come_in_time(spark):
    intake.use_rocksdb(spark)
    first = [(minute(0), "a", "x", 2, 0.1), (minute(3), "a", "x", 1, 0.2), (minute(3), "b", "y", 5, 1.0)]
    second = [(minute(n), "b", "y", 1, 0.1) for n in (8, 9, 25)]
    third = [(minute(40), "b", "y", 1, 0.5)]
    stream = in_files(spark, [first, second, third], "minute timestamp, series string, bucket string, n long, total double")
    out = scratch()
    start_ms = int(minute(5).timestamp() * 1000)
    drain(start(states.trailing_stream(stream, 600, 300, start_ms), out))
    got = [(r.series, round((r.window_end.astimezone(timezone.utc) - minute(0)).total_seconds() / 60), r.n, float(r.total)) for r in spark.read.parquet(f"{out}/data").collect()]
    want = [("a", 5, 3, 0.3), ("a", 10, 3, 0.3), ("b", 5, 5, 1.0), ("b", 10, 7, 1.2), ("b", 15, 2, 0.2), ("b", 30, 1, 0.1), ("b", 35, 1, 0.1)]
    assert sorted(got) == want


def test_bad_scores_fail(spark):
    with pytest.raises(Exception, match="NULL, NaN or infinite"):
        check_scores(spark.createDataFrame([(float("nan"),)], "score double")).collect()
