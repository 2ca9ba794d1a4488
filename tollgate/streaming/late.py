"""K8: late rows of a stream go to a table of their own instead of vanishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.session import checkpointed
from tollgate.sources.batches import BatchTable

MARK_SCHEMA = T.StructType(
    [
        T.StructField("high", T.TimestampType()),
        T.StructField("rows_on_time", T.LongType()),
        T.StructField("rows_late", T.LongType()),
    ]
)


def late_splitter(
    deliver: Callable[[DataFrame, int], None],
    late: BatchTable,
    marks: BatchTable,
    delay_seconds: int,
    ts: str = "created_at",
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that hands rows in time to ``deliver`` and keeps the late ones.

    A row is late if its time is no later than the highest time of the micro-batches up to the last
    but one, less the delay: that is when a stateful operator of Spark would drop it, which filters
    by the watermark of the batch before. The highest time of a batch is kept with the batch, in
    milliseconds as a watermark is, so a batch that is tried again is split as before. Rows
    without a time are in time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = checkpointed(batch)
        known = marks.read(before=batch_id - 1).agg(F.max("high")).first()[0]
        limit = F.date_trunc("millisecond", F.lit(known).cast("timestamp")) - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS")
        is_late = F.coalesce(F.col(ts) <= limit, F.lit(False))
        late.write(rows.where(is_late), batch_id)
        deliver(rows.where(~is_late), batch_id)
        # the mark comes last: a batch with a mark is whole
        counted = rows.agg(
            F.max(ts).cast("timestamp").alias("high"),
            F.count_if(~is_late).alias("rows_on_time"),
            F.count_if(is_late).alias("rows_late"),
        )
        marks.write(counted, batch_id)

    return write
