"""Registered queries of sources and sinks (A1, A2, A5, A8, A10): written, read back and counted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators import chrono
from tollgate.plans.ops_queries import stamped
from tollgate.plans.registry import query, rounded, txn
from tollgate.plans.stream_queries import into
from tollgate.schemas import SPLITS, TRANSACTION_COLUMNS
from tollgate.session import shared_folder
from tollgate.sources import canonical, streams, tables


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


@query(
    "a1_csv_landing",
    """SELECT txn_id % 10 AS part, count(*) AS row_count, count(TRY_CAST(amount AS DOUBLE)) AS amounts, round(sum(TRY_CAST(amount AS DOUBLE)), 4) AS amount_total,
         count(type) AS types, count(TRY_CAST(oldbalanceOrg AS DOUBLE)) AS balances, CAST(sum(TRY_CAST(isFraud AS INT)) AS BIGINT) AS fraud_sum
       FROM landing GROUP BY 1""",
)
def a1(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2: the landing rows as headered CSV files, header checked, read as text and typed. The
    part of a row goes along in the name of its folder."""
    rows, path = canonical.landing(txn(spark, d)), _folder(spark)
    rows = rows.withColumn("part", F.col("txn_id") % 10)
    rows.select("part", *TRANSACTION_COLUMNS).write.option("header", True).partitionBy("part").csv(path)
    made = None
    for part in range(10):
        typed = tables.typed(tables.read_landing_csv(spark, f"{path}/part={part}")).withColumn("part", F.lit(part).cast("bigint"))
        made = typed if made is None else made.unionByName(typed)
    counts = made.groupBy("part").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("amount").alias("amounts"),
        F.sum("amount").alias("amount_total"),
        F.count("type").alias("types"),
        F.count("oldbalanceOrg").alias("balances"),
        F.sum("isFraud").cast("bigint").alias("fraud_sum"),
    )
    return rounded(counts, 4)


@query(
    "a5_split_sink",
    """SELECT split, min(step) AS first_step, max(step) AS last_step, count(*) AS row_count, CAST(sum(txn_id) AS BIGINT) AS id_sum FROM splits GROUP BY split""",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    """The splits written as one version, each read back by itself."""
    rows, path = txn(spark, d), _folder(spark)
    tables.write_splits(rows, chrono.choose_boundaries(rows).split(F.col("step")), path)
    made = None
    for name in SPLITS:
        part = tables.read_split(spark, path, name).withColumn("split", F.lit(name))
        made = part if made is None else made.unionByName(part)
    return made.groupBy("split").agg(
        F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("row_count"), F.sum("txn_id").alias("id_sum")
    )


@query(
    "a8_report_sink",
    """SELECT CAST(step AS BIGINT) AS step, count(*) AS row_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count FROM splits WHERE split = 'train' GROUP BY step""",
)
def a8(spark: SparkSession, d: str) -> DataFrame:
    """A report written twice, the second time with the training rows only, and its newest version."""
    rows, path = txn(spark, d), _folder(spark)
    split = chrono.choose_boundaries(rows).split(F.col("step"))
    report = chrono.step_histogram(rows)
    tables.write_report(report, path)
    tables.write_report(chrono.step_histogram(rows.where(split == "train")), path)
    return tables.read_report(spark, path, report.schema)


@query(
    "a10_outcome_source",
    """SELECT prediction_id, actual_fraud, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, CASE WHEN prediction_id % 13 = 0 THEN '' ELSE source END AS source,
         prediction_id % 13 <> 0 AND prediction_id % 17 <> 0 AS valid FROM (SELECT prediction_id, CASE WHEN prediction_id % 17 = 0 THEN 7 ELSE actual_fraud END AS actual_fraud, observed_at, source FROM outcomes)""",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    """Labels as JSON files with padded, blank and wrong values, read as a stream and cleaned."""
    i = F.col("prediction_id")
    sent = canonical.outcomes(txn(spark, d)).select(
        i.cast("string").alias("prediction_id"),
        F.when(i % 17 == 0, 7).otherwise(F.col("actual_fraud")).alias("actual_fraud"),
        F.col("observed_at").cast("timestamp").alias("observed_at"),
        F.when(i % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), "source", F.lit("  "))).alias("source"),
    )
    path = _folder(spark)
    for part in range(2):
        sent.where(F.col("prediction_id").cast("bigint") % 2 == part).write.mode("append").json(f"{path}/in")
        run = into(streams.outcome_stream(spark, f"{path}/in"), path).trigger(availableNow=True).start()
        run.awaitTermination()
        if run.exception():
            raise run.exception()
    made = spark.read.parquet(f"{path}/data")
    return stamped(made.select(F.col("prediction_id").cast("bigint").alias("prediction_id"), "actual_fraud", "observed_at", "source", "valid"))
