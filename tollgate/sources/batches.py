"""Micro-batch tables. Each batch owns one part and replaces it, so a batch that is retried
after a failure leaves the table as if it had run once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tollgate.sources.versioned import VersionedTable

# Old batches are put together whenever so many parts have come up.
COMPACT_PARTS = 64


class BatchTable:
    """A versioned table with one part per micro-batch, in buckets by a key if it has one."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, buckets: int = 64) -> None:
        self.table = VersionedTable(spark, path, schema, buckets if key else None, key)
        self.schema = schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        self.table.put(df, f"batch-{batch_id}", batch_id)
        if len(self.table.parts()) > COMPACT_PARTS:
            # the last batch may still be tried again
            self.table.compact(batch_id)

    def read(self, before: int | None = None, since: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """All rows, or those of batches before one and from one on; with ``near``, a table with the
        key, only of the buckets in which its keys lie."""
        parts = self.table.parts()
        if before is not None:
            parts = [p for p in parts if p.batch < before]
        if since is not None:
            parts = [p for p in parts if p.batch >= since]
        buckets = None
        if near is not None and self.table.buckets:
            # at most as many rows as there are buckets
            buckets = [r[0] for r in near.select(self.table.bucket_of().alias("b")).distinct().collect()]
        return self.table.rows(parts, buckets)
