"""Deterministic samples and weights. Samples depend on row ids, never on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.exprs import hex_prefix, safe_ratio, seeded_key
from tollgate.operators.ordered import nth_smallest, smallest, up_to
from tollgate.schemas import TARGET

_KEY = "_sample_key"


def keyed(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    return df.withColumn(_KEY, hex_prefix(seeded_key(seed, id_col)))


def hash_sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash of their id (all rows if there are fewer)."""
    return smallest(keyed(df, seed, id_col), n, _KEY, id_col).drop(_KEY)


def profile_sample(
    df: DataFrame, max_negatives: int, seed: int = 42, id_col: str = "txn_id"
) -> DataFrame:
    """All frauds plus the hash sample of the rest."""
    positives = df.where(F.col(TARGET) == 1)
    negatives = df.where(F.col(TARGET) == 0)
    return positives.unionByName(hash_sample(negatives, max_negatives, seed, id_col))


def class_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(TARGET) == 1).alias("frauds"),
        F.count_if(F.col(TARGET) == 0).alias("negatives"),
    )


def weighted_sample(
    df: DataFrame, max_negatives: int, seed: int = 42, id_col: str = "txn_id"
) -> DataFrame:
    """D8 with a ``weight`` column: 1 for frauds, negatives / kept negatives for the rest."""
    counts = class_counts(df).first()
    kept = min(max_negatives, counts["negatives"])
    weight = counts["negatives"] / kept if kept else 0.0
    return profile_sample(df, max_negatives, seed, id_col).withColumn(
        "weight", F.when(F.col(TARGET) == 1, F.lit(1.0)).otherwise(F.lit(float(weight)))
    )


def sample_metadata(original: DataFrame, sampled: DataFrame) -> DataFrame:
    """Counts, fractions and weights of a weighted sample, and whether they add up."""
    before = class_counts(original)
    wide = sampled.agg(
        F.count_if(F.col(TARGET) == 1).alias("sampled_fraud_rows"),
        F.count_if(F.col(TARGET) == 0).alias("sampled_nonfraud_rows"),
        F.max(F.when(F.col(TARGET) == 1, F.col("weight"))).alias("fraud_weight"),
        F.max(F.when(F.col(TARGET) == 0, F.col("weight"))).alias("nonfraud_weight"),
    ).withColumns(
        {
            "original_rows": before.select("rows").scalar(),
            "original_fraud_rows": before.select("frauds").scalar(),
            "original_nonfraud_rows": before.select("negatives").scalar(),
        }
    )
    fraud, kept = F.col("sampled_fraud_rows"), F.col("sampled_nonfraud_rows")
    rest = F.col("original_nonfraud_rows")
    expected = safe_ratio(rest, kept)
    weight = F.coalesce("nonfraud_weight", F.lit(0.0))
    return wide.select(
        "original_rows",
        "original_fraud_rows",
        "original_nonfraud_rows",
        "sampled_fraud_rows",
        "sampled_nonfraud_rows",
        safe_ratio(fraud, F.col("original_fraud_rows")).alias("fraud_sampling_fraction"),
        safe_ratio(kept, rest).alias("nonfraud_sampling_fraction"),
        F.coalesce("fraud_weight", F.lit(1.0)).alias("fraud_weight"),
        weight.alias("nonfraud_weight"),
        (fraud == F.col("original_fraud_rows")).alias("all_frauds_kept"),
        (F.abs(weight - expected) <= 1e-12 * F.greatest(F.abs(weight), F.abs(expected))).alias(
            "weight_matches_counts"
        ),
    )


def balanced_weights(df: DataFrame) -> DataFrame:
    """Total / (2 * class count) per class."""
    per = df.groupBy(F.col(TARGET).alias("label")).agg(F.count(F.lit(1)).alias("class_count"))
    total = per.agg(F.sum("class_count")).scalar()
    return per.withColumn("weight", safe_ratio(total, F.col("class_count") * 2))


def with_balanced_weight(df: DataFrame) -> DataFrame:
    """The balanced weight as a column (two numbers become literals)."""
    counts = class_counts(df).first()
    total = counts["rows"]
    return df.withColumn(
        "weight",
        F.when(F.col(TARGET) == 1, F.lit(total / (2.0 * max(1, counts["frauds"])))).otherwise(
            F.lit(total / (2.0 * max(1, counts["negatives"])))
        ),
    )


def positive_weight(weight: float) -> Column:
    """Fixed weight of the positive class."""
    return F.when(F.col(TARGET) == 1, F.lit(float(weight))).otherwise(F.lit(1.0))


def permuted_labels(df: DataFrame, seed: int = 42, id_col: str = "txn_id") -> DataFrame:
    """Labels shuffled over the rows, class counts kept.

    A shuffled 0/1 label only decides which rows get the ones: a seeded hash sample as large
    as the positive class. The hash uses another seed than the samples above do.
    """
    frauds = class_counts(df).first()["frauds"]
    if not frauds:
        return df
    rows = keyed(df, seed + 1_000_003, id_col)
    edge = nth_smallest(rows, frauds, _KEY, id_col)
    chosen = F.lit(True) if edge is None else up_to(edge, _KEY, id_col)
    return rows.withColumn(TARGET, chosen.cast("int")).drop(_KEY)
