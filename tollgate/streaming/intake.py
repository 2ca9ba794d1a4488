"""K2-K4: idempotent intake and late labels as streams.

Default: foreachBatch over the batch operators, exact for any delay, every batch retry-safe.
Opt-in: keyed state, which touches only the keys of the batch and can forget after a while.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tollgate.operators.ledger import admit_batches, classify_attempts, merge_outcomes
from tollgate.session import checkpointed
from tollgate.sources.batches import BatchTable

INTAKE_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("attempt", T.LongType()),
        T.StructField("payload_hash", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

LABEL_SCHEMA = T.StructType(
    [
        T.StructField("prediction_id", T.StringType()),
        T.StructField("actual_fraud", T.IntegerType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("source", T.StringType()),
    ]
)

REFUSAL_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("submissions", T.LongType()),
        T.StructField("unknown_ids", T.LongType()),
        T.StructField("label_conflicts", T.LongType()),
        T.StructField("stored_conflicts", T.LongType()),
        T.StructField("earlier_conflicts", T.LongType()),
        T.StructField("oversize", T.BooleanType()),
    ]
)


def intake_writer(table: BatchTable) -> Callable[[DataFrame, int], None]:
    """K2: foreachBatch function that classifies deliveries against everything taken in before.

    A ledger in buckets by request_id is read only where the batch's requests lie.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # The micro-batch itself is read several times; its source need not be.
        rows = checkpointed(batch.select("request_id", "attempt", "payload_hash"))
        stored = table.read(before=batch_id, near=rows).where(F.col("status") == "new")
        table.write(
            classify_attempts(rows, stored=stored.select("request_id", "payload_hash")), batch_id
        )

    return write


def outcome_writer(
    events: Callable[[], DataFrame], labels: BatchTable, refusals: BatchTable
) -> Callable[[DataFrame, int], None]:
    """K3, K4: foreachBatch function that merges label batches, refusing faulty ones whole."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = labels.read(before=batch_id)
        rows = checkpointed(batch)
        verdict = checkpointed(admit_batches(rows, events(), stored))
        merged = merge_outcomes(rows, verdict, stored)
        labels.write(merged.where("NOT replayed"), batch_id)
        refusals.write(verdict.where("NOT admitted"), batch_id)

    return write


def distinct_items(items: DataFrame, delay: str = "1 hour", ts: str = "created_at") -> DataFrame:
    """K2, simple variant: repeats of (request_id, item_index) within the watermark drop out."""
    return items.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["request_id", "item_index"])


class FirstPayload(StatefulProcessor):
    """Keeps the payload hash of a key's first delivery and nothing else.

    Rows arrive in Arrow batches and leave in the same batches, so the memory a key needs does
    not depend on how often it is delivered. First means first to arrive.
    """

    def __init__(self, forget_after_ms: int | None = None) -> None:
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("payload_hash", T.StringType())])
        self.first = handle.getValueState("first", schema, self.forget_after_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get()[0] if self.first.exists() else None
        for chunk in rows:
            chunk = chunk.sort_values("attempt", kind="stable")
            status = pd.Series("replay", index=chunk.index)
            if known is None and len(chunk):
                known = chunk["payload_hash"].iloc[0]
                self.first.update((known,))
                status.iloc[0] = "new"
            status[chunk["payload_hash"] != known] = "conflict"
            yield chunk[["request_id", "attempt", "payload_hash"]].assign(status=status)

    def close(self) -> None:
        pass


def classify_with_state(attempts: DataFrame, forget_after_ms: int | None = None) -> DataFrame:
    """K2, K4, keyed state: needs the RocksDB state store provider."""
    return attempts.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=FirstPayload(forget_after_ms),
        outputStructType=INTAKE_SCHEMA,
        outputMode="append",
        timeMode="ProcessingTime" if forget_after_ms else "None",
    )


def label_join(
    events: DataFrame, outcomes: DataFrame, max_delay: str = "48 hours", lateness: str = "1 hour"
) -> DataFrame:
    """K3, opt-in: stream-stream left outer join; a label later than ``max_delay`` is not seen."""
    left = events.withWatermark("created_at", lateness)
    right = outcomes.select(
        F.col("prediction_id").alias("_id"), "actual_fraud", "observed_at"
    ).withWatermark("observed_at", lateness)
    bound = (F.col("observed_at") >= F.col("created_at")) & (
        F.col("observed_at") <= F.col("created_at") + F.expr(f"INTERVAL {max_delay}")
    )
    return left.join(right, (F.col("prediction_id") == F.col("_id")) & bound, "left").drop("_id")


def use_rocksdb(spark: SparkSession) -> None:
    """State store for the keyed variant (a session setting, only where nothing else is set)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    wanted = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    current = spark.conf.get(key)
    if "HDFSBackedStateStoreProvider" in (current or ""):
        spark.conf.set(key, wanted)
