"""Stream sources for prediction requests and late labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.schemas import OUTCOME_SCHEMA, PREDICTION_REQUEST_SCHEMA


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json", **options: str
) -> DataFrame:
    """Files as a stream with a declared schema; other sources differ only in the format."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def request_stream(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Prediction requests, each with its array of transactions."""
    return file_stream(spark, path, PREDICTION_REQUEST_SCHEMA, fmt, **options)


def outcome_stream(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """A10: late labels, cleaned."""
    return clean_outcomes(file_stream(spark, path, OUTCOME_SCHEMA, fmt, **options))


def valid_outcome() -> Column:
    return (
        F.col("prediction_id").isNotNull()
        & F.coalesce(F.col("actual_fraud").isin(0, 1), F.lit(False))
        & F.length("source").between(1, 128)
    )


def clean_outcomes(outcomes: DataFrame) -> DataFrame:
    """A10: source trimmed, missing observed_at set to now, ``valid`` says if the label may pass."""
    trimmed = outcomes.withColumns(
        {
            "source": F.trim("source"),
            "observed_at": F.coalesce("observed_at", F.current_timestamp()),
        }
    )
    return trimmed.withColumn("valid", F.coalesce(valid_outcome(), F.lit(False)))
