"""K1: scoring as a stateless projection; the same function serves batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.exprs import is_finite, predict, risk_level
from tollgate.functions.features import feature_columns
from tollgate.operators.quality import contract
from tollgate.schemas import MEDIUM_THRESHOLD, OPERATIONAL_THRESHOLD, check_model_inputs


def request_items(requests: DataFrame) -> DataFrame:
    """One row per item of each request's array, with its index; B8: items hold the model's inputs
    and nothing else."""
    check_model_inputs(requests.schema["transactions"].dataType.elementType.fieldNames())
    return requests.select(
        *[c for c in requests.columns if c != "transactions"],
        F.posexplode("transactions").alias("item_index", "_item"),
    ).select("*", "_item.*").drop("_item")


def score_rows(
    rows: DataFrame,
    score: Column,
    threshold: float = OPERATIONAL_THRESHOLD,
    medium: float = MEDIUM_THRESHOLD,
) -> DataFrame:
    """Contract, features, score and decision, one projection.

    ``score`` reads feature columns. Rows that break the contract keep their reasons and get no
    score; a caller routes them to quarantine.
    """
    checked = contract(rows)
    valid = F.size("reject_reasons") == 0
    features = {n: F.when(valid, c.cast("float")) for n, c in feature_columns().items()}
    inputs = {c: F.col(f"_in_{c}") for c in rows.columns}
    kept = checked.select(
        *[F.col(c).alias(f"_in_{c}") for c in rows.columns],
        "reject_reasons",
        *[e.alias(n) for n, e in features.items()],
    ).withColumn("fraud_score", score)
    made = kept.select(
        *[c.alias(n) for n, c in inputs.items()], "reject_reasons", "fraud_score"
    )
    s = F.col("fraud_score")
    # A row that keeps the contract has a finite score
    failed = F.raise_error(F.lit("a valid row has no finite score")).cast("double")
    sound = (F.size("reject_reasons") > 0) | (is_finite(s) & s.between(0, 1))
    made = made.withColumn("fraud_score", F.when(F.coalesce(sound, F.lit(False)), s).otherwise(failed))
    return made.withColumns(
        {
            "prediction": predict(s, threshold),
            "threshold": F.lit(float(threshold)),
            "risk_level": F.when(s.isNotNull(), risk_level(s, threshold, medium)),
        }
    )

