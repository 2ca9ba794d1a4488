"""File scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.schemas import (
    LANDING_SCHEMA,
    SPLITS,
    TRANSACTION_COLUMNS,
    TRANSACTION_SCHEMA,
    ContractError,
    check_header,
)
from tollgate.sources.versioned import Part, VersionedTable


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a headered CSV (reads the header only, infers nothing)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_landing_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1, A2: headered transaction CSV as text columns, header checked first."""
    check_header(csv_header(spark, path))
    return (
        spark.read.schema(LANDING_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )


def typed(landing: DataFrame) -> DataFrame:
    """Typed projection of landing rows; text that is no number becomes NULL (see B1)."""
    return landing.select(
        *[
            F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
            for f in TRANSACTION_SCHEMA.fields
        ]
    )


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A3: Parquet scan of the named columns only."""
    return spark.read.parquet(path).select(*columns)


def step_range(df: DataFrame, low: int, high: int) -> DataFrame:
    """A4: inclusive step window; on a Parquet scan it becomes a row-group filter."""
    return df.where(F.col("step").between(low, high))


def write_splits(df: DataFrame, split: Column, path: str) -> None:
    """A5: the three splits, each in a folder of its own under one manifest; all change at once."""
    table = VersionedTable(df.sparkSession, path, df.schema)
    version = table.version()
    table.publish([Part(name, table.store(df.where(split == name))) for name in SPLITS], version + 1)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one split; the other splits' files are not listed."""
    if split not in SPLITS:
        raise ContractError(f"unknown split: {split}")
    folders = [p for p in VersionedTable(spark, path, T.StructType()).parts() if p.key == split]
    if not folders:
        raise ContractError(f"no splits were written to {path}")
    return spark.read.parquet(f"{path}/{folders[0].folder}")


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A long metric table as JSON, or as a versioned Parquet table."""
    if fmt == "parquet":
        VersionedTable(report.sparkSession, path, report.schema).replace(report)
    else:
        report.write.mode("overwrite").format(fmt).save(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version of a report."""
    return VersionedTable(spark, path, schema).rows()


def nested_report(report: DataFrame, section: str = "section") -> DataFrame:
    """Sectioned long report as one map per section (a few dozen entries each)."""
    return report.groupBy(section).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias(
            "metrics"
        )
    )


def transaction_source(df: DataFrame) -> DataFrame:
    """Reorder a typed table to the source column order."""
    return df.select(*TRANSACTION_COLUMNS)
