"""Tables under a manifest: whole versions, whatever breaks off."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tollgate.schemas import ContractError
from tollgate.sources import batches, tables
from tollgate.sources.batches import BatchTable
from tollgate.sources.versioned import VersionedTable


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_broken_write_leaves_the_old_version(spark, path):
    table = VersionedTable(spark, path, spark.range(1).schema)
    assert ids(table.rows()) == [] and table.version() == 0
    table.replace(spark.range(5))
    broken = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("torn")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="torn"):
        table.replace(broken)
    with pytest.raises(Exception, match="torn"):
        table.put(broken, "all")
    assert ids(table.rows()) == [0, 1, 2, 3, 4] and table.version() == 1
    table.replace(spark.range(2))
    assert ids(table.rows()) == [0, 1]
    assert ids(table.rows(table.parts(1))) == [0, 1, 2, 3, 4]  # a reader of the version before goes on
    with pytest.raises(ContractError):
        table.publish([], 2)


def test_splits_change_together(spark, path):
    rows = spark.range(30).withColumn("step", F.col("id"))
    cut = F.when(F.col("step") < 20, "train").when(F.col("step") < 25, "validation").otherwise("test")
    tables.write_splits(rows, cut, path)
    assert [tables.read_split(spark, path, s).count() for s in ("train", "validation", "test")] == [20, 5, 5]
    with pytest.raises(Exception, match="torn"):
        tables.write_splits(rows.withColumn("id", F.when(cut == "test", F.raise_error(F.lit("torn")).cast("bigint")).otherwise(F.col("id"))), cut, path)
    assert [tables.read_split(spark, path, s).count() for s in ("train", "validation", "test")] == [20, 5, 5]


def test_batches_are_replaced_and_put_together(spark, path, monkeypatch):
    monkeypatch.setattr(batches, "COMPACT_PARTS", 3)
    table = BatchTable(spark, path, spark.range(1).schema, key="id", buckets=4)
    for n in range(6):
        table.write(spark.range(10 * n, 10 * n + 3), n)
    table.write(spark.range(50, 53), 5)  # tried again
    assert ids(table.read()) == [10 * n + k for n in range(6) for k in range(3)]
    assert ids(table.read(before=5)) == [10 * n + k for n in range(5) for k in range(3)]
    assert ids(table.read(since=5)) == [50, 51, 52]
    assert len(table.table.parts()) <= 4


def test_a_read_for_some_keys_lists_their_buckets_only(spark, path):
    table = BatchTable(spark, path, spark.range(1).schema, key="id", buckets=16)
    table.write(spark.range(400), 0)
    some = table.read(near=spark.createDataFrame([(7,), (7,)], "id bigint"))
    kept = ids(some)
    assert 7 in kept and len(kept) < 100
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = next(part for part in plan.split("PartitionFilters: ")[1:])
    assert "_bucket" in filters[:200]
    assert {r[0] for r in some.select(F.input_file_name()).collect()} < {r[0] for r in table.read().select(F.input_file_name()).collect()}
