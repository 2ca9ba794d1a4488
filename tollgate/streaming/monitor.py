"""K5-K9: streaming pre-aggregation, monitoring runs per trigger and operational series."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import ArithmeticException, NumberFormatException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tollgate.functions.exprs import status_class
from tollgate.operators.drift import (
    MonitoringConfig,
    ReferenceProfile,
    monitoring_metrics,
    run_summary,
    window_bounds,
)
from tollgate.operators.trailing import event_bins, minute_items
from tollgate.schemas import MONITORING_METRIC_SCHEMA, MONITORING_RUN_SCHEMA, ContractError
from tollgate.sources.batches import BatchTable
from tollgate.sources.versioned import VersionedTable

# ISO text with its offset.
END_SCHEMA = T.StructType([T.StructField("window_end", T.StringType())])


def minute_stream(
    events: DataFrame, profile: ReferenceProfile, lateness: str = "10 minutes"
) -> DataFrame:
    """K5: per-minute totals in append mode; a minute appears once the watermark has passed it."""
    bins = event_bins(events.withWatermark("created_at", lateness), profile, "created_at")
    rows = bins.select(
        "created_at", F.inline(minute_items(profile, F.lit(1), F.col("fraud_score")))
    )
    return (
        rows.where(F.col("bucket").isNotNull())
        .groupBy(F.window("created_at", "1 minute").alias("w"), "series", "bucket")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .select(F.col("w.start").alias("minute"), "series", "bucket", "n", "total")
    )


def rate_stream(
    log: DataFrame, slide: str = "1 minute", lateness: str = "10 minutes"
) -> DataFrame:
    """K9: five-minute request rates that move every ``slide`` (each row counts in 5 windows)."""
    return (
        log.withWatermark("ts", lateness)
        .groupBy(
            F.window("ts", "5 minutes", slide).alias("w"),
            "method",
            "route",
            status_class(F.col("status")).alias("status_class"),
        )
        .agg((F.count(F.lit(1)) / F.lit(300.0)).alias("rate"))
        .select(F.col("w.start").alias("window_start"), "method", "route", "status_class", "rate")
    )


def run_monitoring(
    events: DataFrame,
    outcomes: DataFrame,
    profile: ReferenceProfile,
    end: datetime,
    path: str,
    config: MonitoringConfig = MonitoringConfig(),
) -> str:
    """One monitoring run, written idempotently; returns its status.

    A run is keyed by window and reference version. Its metric rows are put in place first and its
    run row last, each by a new manifest, so a run that is visible is whole and a retry changes
    nothing. Data that break the calculation leave a failed run without metrics, and the reason in
    the log; any other error, such as a lost executor's, is raised, and the run is tried again.
    """
    spark = events.sparkSession
    _, start, end = window_bounds(end, config.window_hours)
    key = f"{start:%Y%m%dT%H%M%S}-{end:%Y%m%dT%H%M%S}-{config.version}"
    run_id = str(uuid.uuid5(uuid.NAMESPACE_OID, key))
    try:
        # About 26 rows.
        found = monitoring_metrics(events, outcomes, profile, end, config).collect()
        rows = [
            (run_id, r.metric_name, r.feature_name, r.metric_value, r.severity, r.sample_size)
            for r in found
        ]
        bad = [r[3] for r in rows if r[3] is not None and not abs(r[3]) < float("inf")]
        if bad:
            raise ValueError("monitoring metric is not finite")
        summary = run_summary(
            spark.createDataFrame(rows, MONITORING_METRIC_SCHEMA), end, config
        ).first()
        counts = (summary["event_count"], summary["labeled_count"])
        status, overall = summary["status"], summary["overall_drift_status"]
    except (ContractError, ArithmeticException, NumberFormatException, SparkRuntimeException, ValueError):
        logging.getLogger(__name__).exception("monitoring run %s failed", key)
        rows, counts, status, overall = [], (0, 0), "failed", "failed"
    metrics, runs = _run_tables(spark, path)
    metrics.put(spark.createDataFrame(rows, MONITORING_METRIC_SCHEMA).coalesce(1), key)
    run = (run_id, start, end, config.version, *counts, status, overall)
    runs.put(spark.createDataFrame([run], MONITORING_RUN_SCHEMA).coalesce(1), key)
    return status


def _run_tables(spark: SparkSession, path: str) -> tuple[VersionedTable, VersionedTable]:
    return (
        VersionedTable(spark, f"{path}/metrics", MONITORING_METRIC_SCHEMA),
        VersionedTable(spark, f"{path}/runs", MONITORING_RUN_SCHEMA),
    )


def monitoring_writer(
    events: Callable[[], DataFrame],
    outcomes: Callable[[], DataFrame],
    profile: ReferenceProfile,
    path: str,
    config: MonitoringConfig = MonitoringConfig(),
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
) -> Callable[[DataFrame, int], None]:
    """K7: foreachBatch function; each trigger recomputes the trailing window from the ledger, so
    late labels are always picked up.

    A batch's window end is the clock at its first attempt. It is kept with the batch, so a batch
    that is tried again computes the same run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = events()
        ends = BatchTable(rows.sparkSession, f"{path}/ends", END_SCHEMA)
        known = ends.read(before=batch_id + 1, since=batch_id).first()
        if known is None:
            ends.write(rows.sparkSession.createDataFrame([(clock().isoformat(),)], END_SCHEMA), batch_id)
            known = ends.read(before=batch_id + 1, since=batch_id).first()
        run_monitoring(rows, outcomes(), profile, datetime.fromisoformat(known["window_end"]), path, config)

    return write


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All runs and their metrics."""
    metrics, runs = _run_tables(spark, path)
    return runs.rows(), metrics.rows()


def dropped_late_rows(query: StreamingQuery) -> int:
    """K8: rows that stateful operators refused because the watermark had passed them."""
    total = 0
    for progress in query.recentProgress:
        for op in progress["stateOperators"]:
            total += int(op.get("numRowsDroppedByWatermark", 0))
    return total
