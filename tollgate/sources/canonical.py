"""Canonical views: the engine's input tables derived from the generic test tables.

``events`` has five event types, as many as there are transaction types, so it serves as
the transaction table. Everything is a narrow projection of one scan; nothing shuffles
except ``requests``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.exprs import predict, risk_level

# Event type to transaction type.
TYPE_OF_EVENT = {
    "signup": "CASH_IN",
    "click": "CASH_OUT",
    "error": "DEBIT",
    "view": "PAYMENT",
    "purchase": "TRANSFER",
}

# Step 1 is the first hour. Interval arithmetic on zone-less timestamps, so the session zone
# plays no part.
_SINCE = "(ts - TIMESTAMP_NTZ'2024-01-01 00:00:00')"
HOURS = f"extract(DAY FROM {_SINCE}) * 24 + extract(HOUR FROM {_SINCE})"

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; ``txn_id`` is unique and breaks ties."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    i, amount, kind = F.col("txn_id"), F.col("amount"), F.col("type")
    pairs = [x for k, v in TYPE_OF_EVENT.items() for x in (F.lit(k), F.lit(v))]
    base = events.select(
        F.col("event_id").alias("txn_id"),
        "ts",
        "user_id",
        F.col("value").alias("amount"),
        (F.expr(HOURS) + 1).cast("bigint").alias("step"),
        F.create_map(*pairs)[F.col("event_type")].alias("type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    cash_like = kind.isin("TRANSFER", "CASH_OUT")
    rows = base.withColumns(
        {
            "oldbalanceOrg": F.when(i % 11 == 0, amount)
            .when(i % 5 == 0, F.lit(0.0))
            .otherwise((F.col("k") * 10).cast("double")),
            "oldbalanceDest": F.when(i % 3 == 0, F.lit(0.0)).otherwise(
                ((i * 13) % 997).cast("double")
            ),
            "isFraud": F.when(cash_like & ((i % 11 == 0) | (i % 97 == 0)), 1).otherwise(0),
            "isFlaggedFraud": F.when((kind == "TRANSFER") & (amount > 200), 1).otherwise(0),
            "r": ((i * 7919) % 10007).cast("double") / F.lit(10007.0),
        }
    )
    r = F.col("r")
    return rows.withColumns(
        {
            "newbalanceOrig": F.greatest(F.col("oldbalanceOrg") - F.col("amount"), F.lit(0.0)),
            "newbalanceDest": F.col("oldbalanceDest") + F.col("amount"),
            "fraud_score": F.when(F.col("isFraud") == 1, F.lit(0.5) + F.lit(0.5) * r).otherwise(
                r * r
            ),
        }
    )


def landing(txn: DataFrame) -> DataFrame:
    """The transactions as raw text with planted faults, as a careless CSV would hold them."""
    i = F.col("txn_id")

    def text(c: str) -> F.Column:
        return F.col(c).cast("string")

    return txn.select(
        "txn_id",
        text("step").alias("step"),
        F.when(i % 113 == 0, "WIRE").when(i % 127 == 0, None).otherwise(F.col("type")).alias("type"),
        F.when(i % 101 == 0, "n/a")
        .when(i % 103 == 0, None)
        .when(i % 107 == 0, "-5.0")
        .otherwise(text("amount"))
        .alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        F.when(i % 131 == 0, "unknown").otherwise(text("oldbalanceOrg")).alias("oldbalanceOrg"),
        text("newbalanceOrig").alias("newbalanceOrig"),
        F.concat(F.lit("M"), (i % 1000).cast("string")).alias("nameDest"),
        text("oldbalanceDest").alias("oldbalanceDest"),
        text("newbalanceDest").alias("newbalanceDest"),
        F.when(i % 109 == 0, "2").otherwise(text("isFraud")).alias("isFraud"),
        F.when(i % 139 == 0, "9").otherwise(text("isFlaggedFraud")).alias("isFlaggedFraud"),
    )


def predictions(txn: DataFrame) -> DataFrame:
    """Prediction events, three to a request."""
    return txn.select(
        F.col("txn_id").alias("prediction_id"),
        (F.col("txn_id") - F.col("txn_id") % 3).alias("request_id"),
        (F.col("txn_id") % 3).cast("int").alias("item_index"),
        "step",
        F.col("type").alias("transaction_type"),
        "amount",
        F.col("oldbalanceOrg").alias("oldbalance_origin"),
        F.col("oldbalanceDest").alias("oldbalance_destination"),
        "fraud_score",
        predict(F.col("fraud_score")).alias("prediction"),
        risk_level(F.col("fraud_score")).alias("risk_level"),
        F.col("ts").alias("created_at"),
    )


def outcomes(txn: DataFrame) -> DataFrame:
    """Late labels for three quarters of the predictions, 0 to 47 hours after the event."""
    return txn.where(F.col("txn_id") % 4 != 0).select(
        F.col("txn_id").alias("prediction_id"),
        F.col("isFraud").alias("actual_fraud"),
        F.expr("timestampadd(HOUR, CAST(txn_id % 48 AS INT), ts)").alias("observed_at"),
        F.lit("review").alias("source"),
    )


def requests(preds: DataFrame) -> DataFrame:
    return preds.groupBy("request_id").agg(
        F.min("created_at").alias("created_at"),
        F.count(F.lit(1)).alias("batch_size"),
        F.when(F.count(F.lit(1)) == 1, "/predict").otherwise("/predict/batch").alias("endpoint"),
    )


def intake_attempts(txn: DataFrame) -> DataFrame:
    """Deliveries of requests: first try, identical retry (10 %), altered retry (4 %)."""
    i = F.col("txn_id")
    tries = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("attempt"), F.col("amount").alias("amount")),
            F.when(i % 10 == 0, F.struct(F.lit(2).alias("attempt"), F.col("amount").alias("amount"))),
            F.when(
                i % 25 == 0,
                F.struct(F.lit(3).alias("attempt"), (F.col("amount") + 1).alias("amount")),
            ),
        )
    )
    return txn.select(F.col("txn_id").alias("request_id"), F.inline(tries))


def outcome_submissions(txn: DataFrame) -> DataFrame:
    """Label batches of about 50 with unknown ids, inner conflicts, stored conflicts and repeats,
    in the same batch and, some with another label, in the next one.

    ``stored_outcomes`` holds the labels that are already known before these arrive.
    """
    i = F.col("txn_id")
    plain = F.struct(
        F.lit(0).alias("copy"),
        F.when(i % 997 == 0, -i - 1).otherwise(i).alias("prediction_id"),
        F.when(i % 1009 == 0, 1 - F.col("isFraud"))
        .otherwise(F.col("isFraud"))
        .alias("actual_fraud"),
    )
    again = F.struct(
        F.lit(1).alias("copy"),
        i.alias("prediction_id"),
        F.when(i % 1013 == 0, 1 - F.col("isFraud"))
        .otherwise(F.col("isFraud"))
        .alias("actual_fraud"),
    )
    next_batch = F.struct(
        F.lit(2).alias("copy"),
        i.alias("prediction_id"),
        F.when(i % 143 == 0, 1 - F.col("isFraud"))
        .otherwise(F.col("isFraud"))
        .alias("actual_fraud"),
    )
    rows = F.array_compact(
        F.array(plain, F.when(i % 7 == 0, again), F.when(i % 11 == 0, next_batch))
    )
    at = F.col("txn_id") + F.when(F.col("copy") == 2, 50).otherwise(0)
    return txn.select(i.alias("txn_id"), F.inline(rows)).select(
        F.floor(at / 50).cast("bigint").alias("batch_id"),
        (at * 4 + F.col("copy")).alias("position"),
        "prediction_id",
        "actual_fraud",
        F.concat(F.lit("desk"), (F.col("txn_id") % 3).cast("string")).alias("source"),
    )


def stored_outcomes(txn: DataFrame) -> DataFrame:
    return txn.where(F.col("txn_id") % 9 == 0).select(
        F.col("txn_id").alias("prediction_id"), F.col("isFraud").alias("actual_fraud")
    )


def request_log(txn: DataFrame) -> DataFrame:
    return txn.select(
        "txn_id",
        "ts",
        F.lit("POST").alias("method"),
        F.concat(F.lit("/"), F.col("type")).alias("route"),
        (F.col("amount") / 100).alias("duration_seconds"),
        F.when((F.col("type") == "DEBIT") & (F.col("txn_id") % 2 == 0), 503)
        .otherwise(200)
        .alias("status"),
    )


def gauges(txn: DataFrame) -> DataFrame:
    """Samples of three gauges at irregular times: readiness of the service, whether the target of
    a transaction type is up, and a feature's drift severity (0 stable, 1 moderate, 2 significant)."""
    i = F.col("txn_id")
    rows = F.array(
        F.struct(F.lit("ready").alias("gauge"), F.lit("api").alias("instance"), F.when(i % 4 == 0, 0).otherwise(1).alias("value")),
        F.struct(F.lit("up").alias("gauge"), F.col("type").alias("instance"), F.when(i % 7 < 2, 0).otherwise(1).alias("value")),
        F.struct(F.lit("drift_severity").alias("gauge"), F.lit("log_amount").alias("instance"), F.when(i % 5 < 3, 2).otherwise(i % 2).cast("int").alias("value")),
    )
    return txn.select("ts", F.inline(rows))
