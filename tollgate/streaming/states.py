"""K4, K6, K9: keyed state for labels, trailing windows and alerts.

Windows and alerts have few keys; their state is a few numbers or one ring, whatever the history, and
what a key needs to do when nothing arrives any more is left to event-time timers. Predictions are many, so their
state is kept by bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tollgate.functions.exprs import status_class
from tollgate.operators.ledger import admit_batches, merge_outcomes
from tollgate.operators.series import (
    ERROR_RATE_ALERT,
    LATENCY_ALERT,
    LATENCY_BOUNDS,
    WINDOW_SECONDS,
    bucket_quantile,
)
from tollgate.session import checkpointed
from tollgate.sources.batches import BatchTable

# Buckets of predictions in the state of label claims: 8 bytes a prediction that was sent for.
CLAIM_BUCKETS = 1024

CLAIM_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("prediction_id", T.LongType()),
        T.StructField("actual_fraud", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("claimed", T.BooleanType()),
    ]
)

WINDOW_SCHEMA = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("n", T.LongType()),
        T.StructField("total", T.DecimalType(38, 12)),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("alert", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("pending_since", T.TimestampType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("last_true", T.TimestampType()),
        T.StructField("points", T.LongType()),
    ]
)


class LabelClaims(StatefulProcessor):
    """K4: which predictions a label was sent for before, kept per bucket of predictions.

    Whether a batch is admitted is known only when all its rows are judged, and a refused batch must
    leave no trace, so the state does not decide: it says which rows need the stored labels at all.
    A group per prediction would cost a millisecond of Python for each; so a bucket's ids are one
    packed, sorted array, next to the times of their last rows if they are ever forgotten. Forgotten predictions
    count as not sent for.
    """

    def __init__(self, forget_after_ms: int | None = None) -> None:
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = ["ids", "times"] if self.forget_after_ms else ["ids"]
        self.sent = handle.getValueState("sent", T.StructType([T.StructField(n, T.BinaryType()) for n in names]), None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [np.frombuffer(v, "int64") for v in self.sent.get()] if self.sent.exists() else [np.empty(0, "int64")] * 2
        ids, new = held[0], []
        if self.forget_after_ms:
            now = timerValues.getCurrentProcessingTimeInMs()
            kept = held[1] > now - self.forget_after_ms
            ids, times = ids[kept], held[1][kept]
        for chunk in rows:
            chunk = chunk[CLAIM_SCHEMA.fieldNames()[:-1]]
            if key[0] < 0:
                yield chunk.assign(claimed=False)
                continue
            given = chunk["prediction_id"].to_numpy("int64")
            new.append(np.unique(given))
            yield chunk.assign(claimed=np.isin(given, ids))
        if not new:
            return
        fresh = np.unique(np.concatenate(new))
        every = np.union1d(ids, fresh)
        if self.forget_after_ms:
            last = np.full(len(every), now, "int64")
            last[np.searchsorted(every, ids)] = times
            last[np.searchsorted(every, fresh)] = now
            self.sent.update((every.tobytes(), last.tobytes()))
        else:
            self.sent.update((every.tobytes(),))

    def close(self) -> None:
        pass


def claimed_labels(submissions: DataFrame, forget_after_ms: int | None = None, buckets: int = CLAIM_BUCKETS) -> DataFrame:
    """K4, first stage: submissions with ``claimed``, whether an earlier micro-batch held a label for
    the prediction. Needs the RocksDB state store provider; ``buckets`` must stay the same as long as
    a stream's checkpoint lives. Rows without a prediction are never claimed."""
    bucket = F.when(F.col("prediction_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("prediction_id"), F.lit(buckets)).cast("int"))
    return submissions.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=LabelClaims(forget_after_ms),
        outputStructType=CLAIM_SCHEMA,
        outputMode="append",
        timeMode="ProcessingTime" if forget_after_ms else "None",
    )


def label_writer(
    events: Callable[[], DataFrame],
    before: DataFrame,
    labels: BatchTable,
    verdicts: BatchTable,
    merged: BatchTable,
) -> Callable[[DataFrame, int], None]:
    """K4, second stage: refuses faulty label batches whole and merges the others.

    ``before`` holds the labels from before the stream began. Of those stored since, only the labels
    of predictions that were sent for before are read, and only from their buckets if ``labels`` has
    any; no other one can clash or be a repeat.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = checkpointed(batch)
        again = rows.where("claimed").select("prediction_id").distinct()
        since = labels.read(before=batch_id, near=again).join(again, "prediction_id", "left_semi")
        stored = checkpointed(before.unionByName(since.select("prediction_id", "actual_fraud")))
        verdict = checkpointed(admit_batches(rows, events(), stored))
        made = checkpointed(merge_outcomes(rows, verdict, stored))
        labels.write(made.where("NOT replayed"), batch_id)
        merged.write(made, batch_id)
        verdicts.write(verdict, batch_id)

    return write


class TrailingRing(StatefulProcessor):
    """K6: the minutes of one series and bucket that a window can still need.

    Totals are decimals and are added up anew for every window end, so nothing is ever subtracted.
    A window end is due when the watermark has passed it. The ring holds the minutes of one window
    length, and those between the watermark and the newest minute.
    """

    def __init__(self, length_ms: int, every_ms: int, first_end_ms: int) -> None:
        self.length, self.every, self.first_end = length_ms, every_ms, first_end_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ring = T.StructType(
            [
                T.StructField("minutes", T.ArrayType(T.LongType())),
                T.StructField("counts", T.ArrayType(T.LongType())),
                T.StructField("totals", T.ArrayType(T.StringType())),
                T.StructField("next_end", T.LongType()),
            ]
        )
        self.handle, self.ring = handle, handle.getValueState("ring", ring, None)

    def _end_after(self, minute: int) -> int:
        """The first window end that a minute counts for."""
        steps = -(-(minute + 1 - self.first_end) // self.every)
        return self.first_end + max(0, steps) * self.every

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        minutes, counts, totals, next_end = self.ring.get() if self.ring.exists() else ([], [], [], None)
        held = {m: (n, t) for m, n, t in zip(minutes, counts, totals)}
        for chunk in rows:
            at = chunk["minute"].astype("datetime64[ms]").astype("int64")
            for m, n, t in zip(at.tolist(), chunk["n"].tolist(), chunk["total"].tolist()):
                held[m] = (n, str(t))
        if not held:
            return iter(())
        order = sorted(held)
        due = self._end_after(order[0])
        next_end = due if next_end is None else max(next_end, due)
        self.ring.update((order, [held[m][0] for m in order], [held[m][1] for m in order], next_end))
        self.handle.registerTimer(next_end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ring.exists():
            return
        minutes, counts, totals, end = self.ring.get()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        while minutes and end <= now:
            while minutes and minutes[0] < end - self.length:
                minutes, counts, totals = minutes[1:], counts[1:], totals[1:]
            inside = sum(m < end for m in minutes)
            if inside:
                total = sum((Decimal(t) for t in totals[:inside]), Decimal(0))
                out.append((*key, pd.Timestamp(end, unit="ms"), sum(counts[:inside]), total))
                end += self.every
            elif minutes:
                end = self._end_after(minutes[0])
        if not minutes:
            self.ring.clear()
        else:
            self.ring.update((list(minutes), list(counts), list(totals), end))
            self.handle.registerTimer(end)
        if out:
            yield pd.DataFrame(out, columns=WINDOW_SCHEMA.fieldNames())

    def close(self) -> None:
        pass


def trailing_stream(minutes: DataFrame, length_seconds: int, every_seconds: int, first_end_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """K6 as a stream of closed minutes (minute, series, bucket, n, total): per series and bucket the
    sums over [end - length, end) for every window end that the watermark has passed.

    Ends are ``every_seconds`` apart from ``first_end_ms`` on; empty windows give no row.
    """
    exact = F.col("total").cast("decimal(38,12)")
    rows = minutes.select("minute", "series", "bucket", "n", exact.alias("total"))
    return rows.withWatermark("minute", lateness).groupBy("series", "bucket").transformWithStateInPandas(
        statefulProcessor=TrailingRing(length_seconds * 1000, every_seconds * 1000, first_end_ms),
        outputStructType=WINDOW_SCHEMA,
        outputMode="append",
        timeMode="EventTime",
    )


class AlertMachine(StatefulProcessor):
    """K9: pending, firing, resolved.

    A stretch of true points one step apart is pending until it has lasted ``hold``, then it fires.
    A false point ends it, and so does a missing one: a timer goes off once the watermark is past the
    place where the next point should have been, also if the series has fallen silent.
    """

    def __init__(self, hold_ms: int, step_ms: int) -> None:
        self.hold, self.step = hold_ms, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = ["since", "last", "points"]
        self.handle = handle
        self.state = handle.getValueState("stretch", T.StructType([T.StructField(n, T.LongType()) for n in names]), None)

    def _row(self, key, status: str, since: int, at: int, last: int, points: int) -> tuple:
        stamp = lambda ms: pd.Timestamp(ms, unit="ms")
        return (key[0], status, stamp(since), stamp(at), stamp(last), points)

    def _fired(self, points: int) -> bool:
        return (points - 1) * self.step >= self.hold

    def _end(self, key, stretch: tuple | None, at: int) -> list[tuple]:
        if stretch is None or not self._fired(stretch[2]):
            return []
        since, last, points = stretch
        return [self._row(key, "resolved", since, at, last, points)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stretch, out = tuple(self.state.get()) if self.state.exists() else None, []
        for chunk in rows:
            chunk = chunk.sort_values("window_start")
            at = chunk["window_start"].astype("datetime64[ms]").astype("int64")
            for t, bad in zip(at.tolist(), chunk["bad"].tolist()):
                if stretch is not None and (not bad or t != stretch[1] + self.step):
                    out += self._end(key, stretch, min(t, stretch[1] + self.step))
                    stretch = None
                if not bad:
                    continue
                since, points = (t, 1) if stretch is None else (stretch[0], stretch[2] + 1)
                if points == 1:
                    out.append(self._row(key, "pending", since, t, t, 1))
                if self._fired(points) and (points == 1 or not self._fired(points - 1)):
                    out.append(self._row(key, "firing", since, since + self.hold, t, points))
                stretch = (since, t, points)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if stretch is None:
            self.state.clear()
        else:
            self.state.update(stretch)
            self.handle.registerTimer(stretch[1] + self.step + 1)
        if out:
            yield pd.DataFrame(out, columns=ALERT_SCHEMA.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            stretch = tuple(self.state.get())
            if timerValues.getCurrentWatermarkInMs() > stretch[1] + self.step:
                self.state.clear()
                if out := self._end(key, stretch, stretch[1] + self.step):
                    yield pd.DataFrame(out, columns=ALERT_SCHEMA.fieldNames())

    def close(self) -> None:
        pass


def alert_stream(points: DataFrame, hold_seconds: int, step_seconds: int = WINDOW_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """K9: transitions of every alert over a stream of points (window_start, alert, bad).

    A micro-batch's points of one alert are taken in order; points arrive in the order of windows.
    """
    return points.withWatermark("window_start", lateness).groupBy("alert").transformWithStateInPandas(
        statefulProcessor=AlertMachine(hold_seconds * 1000, step_seconds * 1000),
        outputStructType=ALERT_SCHEMA,
        outputMode="append",
        timeMode="EventTime",
    )


def alert_points_stream(log: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """K9: the points of the error-rate and latency rules, once their five minutes are closed."""
    duration = F.greatest(F.col("duration_seconds"), F.lit(0.0))
    length = f"{WINDOW_SECONDS} seconds"
    per_route = (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", length).alias("w"), "route")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(status_class(F.col("status")) == "5xx").alias("failed"),
            *[F.count_if(duration <= b).alias(f"le{i}") for i, b in enumerate(LATENCY_BOUNDS)],
        )
    )
    les = [F.col(f"le{i}") for i in range(len(LATENCY_BOUNDS))]
    p95 = bucket_quantile(0.95, LATENCY_BOUNDS, les, F.col("total"))
    whole = per_route.groupBy(F.window(F.window_time("w"), length).alias("v")).agg(
        F.sum("total").alias("total"), F.sum("failed").alias("failed"), F.max(p95).alias("p95")
    )
    seconds = F.lit(float(WINDOW_SECONDS))
    rate = (F.col("failed") / seconds) / F.greatest(F.col("total") / seconds, F.lit(1e-6))

    def point(name: str, bad: Column) -> Column:
        return F.struct(F.lit(name).alias("alert"), bad.alias("bad"))

    rules = F.array(
        point("high_error_rate", rate > ERROR_RATE_ALERT[0]),
        point("high_p95_latency", F.col("p95") > LATENCY_ALERT[0]),
    )
    return whole.select(F.col("v.start").alias("window_start"), F.inline(rules))
