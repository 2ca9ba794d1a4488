"""Registered queries for scans, quality, features, splits, samples and profiles (A-E)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.features import FEATURE_GROUPS, FEATURES, add_features
from tollgate.operators import chrono, ledger, profile, quality, sampling
from tollgate.operators.chrono import StepWindow
from tollgate.plans.registry import marked_text, query, rounded, txn
from tollgate.schemas import MODEL_INPUTS, TARGET, TRANSACTION_COLUMNS
from tollgate.sources import canonical, tables

WINDOW_START = datetime(2024, 1, 30, tzinfo=timezone.utc)
WINDOW_END = datetime(2024, 1, 31, tzinfo=timezone.utc)


def train_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("step") <= chrono.choose_boundaries(rows).train)


def periods_of(rows: DataFrame) -> dict[str, StepWindow]:
    found = chrono.audit_periods(rows)
    return {p: found[p] for p in ("train", "inner_tuning", "official_validation")}


@query(
    "split_fraud_rates",
    """SELECT split, type, count(*) AS row_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
       round(sum(isFraud)/CAST(count(*) AS DOUBLE)*100, 6) AS fraud_percentage
       FROM splits GROUP BY split, type""",
)
def split_fraud_rates(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: fraud rate per chronological split and transaction type."""
    rows = txn(spark, d)
    bounds = chrono.choose_boundaries(rows)
    fraud = F.sum(TARGET)
    return rounded(
        rows.groupBy(bounds.split(F.col("step")).alias("split"), "type").agg(
            F.count(F.lit(1)).alias("row_count"),
            fraud.alias("fraud_count"),
            (fraud / F.count(F.lit(1)) * 100).alias("fraud_percentage"),
        )
    )


@query(
    "a3_column_scan",
    "SELECT event_type, count(*) AS row_count, round(sum(value), 2) AS amount FROM events GROUP BY event_type",
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    scan = tables.read_columns(spark, f"{d}/events.parquet", ["event_type", "value"])
    return rounded(
        scan.groupBy("event_type").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("value").alias("amount")
        ),
        2,
    )


@query(
    "a4_step_range",
    """SELECT step, count(*) AS row_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count
       FROM txn WHERE step BETWEEN 100 AND 300 GROUP BY step""",
)
def a4(spark: SparkSession, d: str) -> DataFrame:
    return chrono.step_histogram(tables.step_range(txn(spark, d), 100, 300))


@query(
    "a6_window_events",
    """SELECT p.prediction_id, strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, p.prediction, p.risk_level, o.actual_fraud
       FROM predictions p LEFT JOIN outcomes o ON p.prediction_id = o.prediction_id
       WHERE p.created_at >= TIMESTAMP '2024-01-30 00:00:00' AND p.created_at < TIMESTAMP '2024-01-31 00:00:00'""",
)
def a6(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    found = ledger.window_events(
        canonical.predictions(rows), canonical.outcomes(rows), WINDOW_START, WINDOW_END
    )
    return found.select(
        "prediction_id",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "prediction",
        "risk_level",
        "actual_fraud",
    )


@query(
    "a9_request_items",
    """SELECT request_id, item_index, step, transaction_type AS type, amount, oldbalance_origin AS "oldbalanceOrg",
       oldbalance_destination AS "oldbalanceDest" FROM predictions""",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    """Batch requests carry an array of transactions; posexplode gives the item index."""
    items = F.struct(*[F.col(c) for c in MODEL_INPUTS])
    rows = txn(spark, d)
    # At most three items to a request in this view.
    asked = rows.groupBy((F.col("txn_id") - F.col("txn_id") % 3).alias("request_id")).agg(
        F.array_compact(
            F.array(*[F.max(F.when(F.col("txn_id") % 3 == i, items)) for i in range(3)])
        ).alias("transactions")
    )
    return asked.select("request_id", F.posexplode("transactions").alias("item_index", "t")).select(
        "request_id", "item_index", "t.*"
    )


_NUMBERS = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]


@query(
    "b1_coercion",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE "{c}" IS NOT NULL AND TRY_CAST("{c}" AS DOUBLE) IS NULL) AS violations FROM landing"""
        for c in _NUMBERS
    ),
)
def b1(spark: SparkSession, d: str) -> DataFrame:
    return quality.coercion_violations(canonical.landing(txn(spark, d)))


@query(
    "b2_missing",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count("{c}") AS missing FROM landing"""
        for c in TRANSACTION_COLUMNS
    )
    + " UNION ALL SELECT 'total', CAST("
    + " + ".join(f'(count(*) - count("{c}"))' for c in TRANSACTION_COLUMNS)
    + " AS BIGINT) FROM landing",
)
def b2(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_counts(canonical.landing(txn(spark, d)), TRANSACTION_COLUMNS)


@query(
    "b3_negative_amounts",
    "SELECT count(*) FILTER (WHERE TRY_CAST(amount AS DOUBLE) < 0) AS negative_amounts FROM landing",
)
def b3(spark: SparkSession, d: str) -> DataFrame:
    return quality.negative_amounts(canonical.landing(txn(spark, d)))


@query(
    "b4_domain_violations",
    """SELECT 'isFraud' AS column_name, isFraud AS bad_value, count(*) AS row_count FROM landing WHERE isFraud NOT IN ('0','1') GROUP BY isFraud
       UNION ALL SELECT 'isFlaggedFraud', isFlaggedFraud, count(*) FROM landing WHERE isFlaggedFraud NOT IN ('0','1') GROUP BY isFlaggedFraud
       UNION ALL SELECT 'type', type, count(*) FROM landing WHERE type NOT IN ('CASH_IN','CASH_OUT','DEBIT','PAYMENT','TRANSFER') GROUP BY type""",
)
def b4(spark: SparkSession, d: str) -> DataFrame:
    return quality.domain_violations(canonical.landing(txn(spark, d)))


@query(
    "b6_quality_report",
    """+ s AS (SELECT count(*) AS n, count(*) FILTER (WHERE isFraud='1') AS fr, count(*) FILTER (WHERE isFlaggedFraud='1') AS fl,
          min(TRY_CAST(amount AS DOUBLE)) AS lo, max(TRY_CAST(amount AS DOUBLE)) AS hi,
          count(*) FILTER (WHERE txn_id%113=0 OR txn_id%127=0 OR txn_id%101=0 OR txn_id%103=0 OR txn_id%107=0 OR txn_id%131=0 OR txn_id%109=0 OR txn_id%139=0) AS bad
          FROM landing),
       u AS (SELECT 'total_rows' AS metric, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'fraud_count', fr FROM s
             UNION ALL SELECT 'non_fraud_count', n-fr FROM s UNION ALL SELECT 'fraud_percentage', fr/CAST(n AS DOUBLE)*100 FROM s
             UNION ALL SELECT 'flagged_fraud_count', fl FROM s UNION ALL SELECT 'amount_min', lo FROM s
             UNION ALL SELECT 'amount_max', hi FROM s UNION ALL SELECT 'passed', CASE WHEN bad=0 THEN 1 ELSE 0 END FROM s)
       SELECT 'summary' AS section, metric, round(value, 6) AS value FROM u
       UNION ALL SELECT 'transaction_count_by_type', type, CAST(count(*) AS DOUBLE) FROM landing WHERE type IS NOT NULL GROUP BY type
       UNION ALL SELECT 'fraud_count_by_type', type, CAST(count(*) AS DOUBLE) FROM landing WHERE type IS NOT NULL AND isFraud='1' GROUP BY type""",
)
def b6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.quality_report(canonical.landing(txn(spark, d))))


@query(
    "b7_quarantine",
    """SELECT txn_id, array_to_string(list_filter([
         CASE WHEN TRY_CAST(amount AS DOUBLE) IS NULL THEN 'amount_not_finite' END,
         CASE WHEN TRY_CAST("oldbalanceOrg" AS DOUBLE) IS NULL THEN 'oldbalanceOrg_not_finite' END,
         CASE WHEN TRY_CAST(amount AS DOUBLE) < 0 THEN 'amount_negative' END,
         CASE WHEN type IS NULL OR type = 'WIRE' THEN 'type_unknown' END], lambda z: z IS NOT NULL), ',') AS reasons
       FROM landing WHERE TRY_CAST(amount AS DOUBLE) IS NULL OR TRY_CAST("oldbalanceOrg" AS DOUBLE) IS NULL
         OR TRY_CAST(amount AS DOUBLE) < 0 OR type IS NULL OR type = 'WIRE'""",
)
def b7(spark: SparkSession, d: str) -> DataFrame:
    bad = quality.quarantine_rows(quality.contract(canonical.landing(txn(spark, d))))
    return bad.select("txn_id", F.array_join("reject_reasons", ",").alias("reasons"))


_EVENT_RULES = [
    ("item_index_nonnegative", "item_index >= 0"),
    ("step_positive", "step >= 1"),
    ("transaction_type_valid", "transaction_type IN ('CASH_IN','CASH_OUT','DEBIT','PAYMENT','TRANSFER')"),
    ("amount_finite_nonnegative", "amount >= 0 AND amount < 1.7976931348623157e308"),
    ("oldbalance_origin_finite_nonnegative", "oldbalance_origin >= 0 AND oldbalance_origin < 1.7976931348623157e308"),
    ("oldbalance_destination_finite_nonnegative", "oldbalance_destination >= 0 AND oldbalance_destination < 1.7976931348623157e308"),
    ("fraud_score_range", "fraud_score >= 0 AND fraud_score <= 1"),
    ("prediction_valid", "prediction IN (0,1)"),
    ("risk_level_valid", "risk_level IN ('low','medium','high')"),
]
_FAULTY_EVENTS = """+ ev AS (SELECT CASE WHEN prediction_id%501=0 THEN prediction_id+1 ELSE prediction_id END AS prediction_id,
          CASE WHEN prediction_id%301=0 THEN -request_id-1 ELSE request_id END AS request_id, item_index,
          CASE WHEN prediction_id%401=0 THEN 0 ELSE step END AS step, transaction_type,
          CASE WHEN prediction_id%211=0 THEN -amount-1 ELSE amount END AS amount, oldbalance_origin, oldbalance_destination,
          CASE WHEN prediction_id%307=0 THEN 1.5 ELSE fraud_score END AS fraud_score, prediction, risk_level FROM predictions)
"""


def faulty_events(preds: DataFrame) -> DataFrame:
    """Predictions with planted constraint faults."""
    i = F.col("prediction_id")
    return preds.withColumns(
        {
            "prediction_id": F.when(i % 501 == 0, i + 1).otherwise(i),
            "request_id": F.when(i % 301 == 0, -F.col("request_id") - 1).otherwise(F.col("request_id")),
            "step": F.when(i % 401 == 0, F.lit(0)).otherwise(F.col("step")),
            "amount": F.when(i % 211 == 0, -F.col("amount") - 1).otherwise(F.col("amount")),
            "fraud_score": F.when(i % 307 == 0, F.lit(1.5)).otherwise(F.col("fraud_score")),
        }
    )


@query(
    "b9_constraints",
    _FAULTY_EVENTS
    + "SELECT 'prediction_requests' AS table_name, 'batch_size_positive' AS constraint_name, count(*) FILTER (WHERE NOT (batch_size > 0)) AS violations FROM requests\n"
    + "".join(
        f"UNION ALL SELECT 'prediction_events', '{n}', count(*) FILTER (WHERE NOT ({p})) FROM ev\n"
        for n, p in _EVENT_RULES
    )
    + """UNION ALL SELECT 'prediction_outcomes', 'actual_fraud_valid', count(*) FILTER (WHERE actual_fraud NOT IN (0,1)) FROM outcomes
       UNION ALL SELECT 'prediction_outcomes', 'source_nonempty', count(*) FILTER (WHERE NOT (length(trim(source)) > 0)) FROM outcomes
       UNION ALL SELECT 'prediction_requests', 'request_id_unique', count(*) FROM (SELECT request_id FROM requests GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'prediction_events', 'prediction_id_unique', count(*) FROM (SELECT prediction_id FROM ev GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'prediction_events', 'request_item_unique', count(*) FROM (SELECT request_id, item_index FROM ev GROUP BY 1, 2 HAVING count(*) > 1)
       UNION ALL SELECT 'prediction_outcomes', 'prediction_id_unique', count(*) FROM (SELECT prediction_id FROM outcomes GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'prediction_events', 'request_id_exists', count(*) FROM ev WHERE request_id NOT IN (SELECT request_id FROM requests)
       UNION ALL SELECT 'prediction_outcomes', 'prediction_id_exists', count(*) FROM outcomes WHERE prediction_id NOT IN (SELECT prediction_id FROM ev)""",
)
def b9(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    preds = canonical.predictions(rows)
    return quality.audit_constraints(
        canonical.requests(preds), faulty_events(preds), canonical.outcomes(rows)
    )


@query(
    "b10_fingerprint",
    f"""+ h AS (SELECT md5(concat_ws('#', {', '.join(map(marked_text, ["step", "type", "amount", "oldbalanceOrg", "oldbalanceDest"]))})) AS h FROM train)
       SELECT count(*) AS row_count, concat_ws('-', {', '.join(f"CAST(coalesce(sum(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS BIGINT)), 0) AS VARCHAR)" for i in range(4))}) AS fingerprint FROM h""",
)
def b10(spark: SparkSession, d: str) -> DataFrame:
    return quality.fingerprint(train_of(txn(spark, d)), MODEL_INPUTS)


@query(
    "b11_request_completeness",
    """+ ev AS (SELECT * FROM predictions WHERE prediction_id%50<>1)
       SELECT r.request_id, r.batch_size, coalesce(e.items, 0) AS items,
              coalesce(e.items = r.batch_size AND e.lo = 0 AND e.hi = r.batch_size-1, FALSE) AS complete
       FROM requests r LEFT JOIN (SELECT request_id, count(*) AS items, min(item_index) AS lo, max(item_index) AS hi FROM ev GROUP BY 1) e
         ON r.request_id = e.request_id""",
)
def b11(spark: SparkSession, d: str) -> DataFrame:
    preds = canonical.predictions(txn(spark, d))
    kept = preds.where(F.col("prediction_id") % 50 != 1)
    return quality.request_completeness(canonical.requests(preds), kept)


@query(
    "b12_score_contract",
    _FAULTY_EVENTS
    + """SELECT 'score_finite_in_unit_range' AS rule, count(*) FILTER (WHERE NOT fraud_score BETWEEN 0 AND 1) AS violations FROM ev
       UNION ALL SELECT 'prediction_binary', count(*) FILTER (WHERE prediction NOT IN (0,1)) FROM ev
       UNION ALL SELECT 'risk_level_known', count(*) FILTER (WHERE risk_level NOT IN ('low','medium','high')) FROM ev""",
)
def b12(spark: SparkSession, d: str) -> DataFrame:
    return quality.score_contract(faulty_events(canonical.predictions(txn(spark, d))))


_FEATURE_SQL = {
    "step": "step",
    "hour_of_day": "(step-1)%24",
    "hour_sin": "sin(2*pi()*((step-1)%24)/24)",
    "hour_cos": "cos(2*pi()*((step-1)%24)/24)",
    "log_amount": "ln(1+amount)",
    "log_oldbalance_origin": "ln(1+oldbalanceOrg)",
    "log_oldbalance_destination": "ln(1+oldbalanceDest)",
    "log_amount_to_origin_balance": "ln(1+amount/(oldbalanceOrg+1))",
    "log_amount_to_destination_balance": "ln(1+amount/(oldbalanceDest+1))",
    "origin_balance_zero_before": "CASE WHEN oldbalanceOrg=0 THEN 1 ELSE 0 END",
    "destination_balance_zero_before": "CASE WHEN oldbalanceDest=0 THEN 1 ELSE 0 END",
    "amount_exceeds_origin_balance": "CASE WHEN amount>oldbalanceOrg THEN 1 ELSE 0 END",
    **{
        f"type_{t}": f"CASE WHEN type='{t}' THEN 1 ELSE 0 END"
        for t in ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
    },
}
FEATURES_CTE = (
    "+ feats AS (SELECT txn_id, split, isFraud, amount AS raw_amount, "
    + ", ".join(f"CAST(CAST({e} AS FLOAT) AS DOUBLE) AS {n}" for n, e in _FEATURE_SQL.items())
    + " FROM splits)\n"
)


@query(
    "c1_features",
    FEATURES_CTE + "SELECT txn_id, " + ", ".join(f"round({n}, 5) AS {n}" for n in FEATURES) + " FROM feats",
)
def c1(spark: SparkSession, d: str) -> DataFrame:
    """C1-C18 for every transaction."""
    rows = add_features(txn(spark, d), keep=["txn_id"])
    return rows.select(
        "txn_id", *[F.round(F.col(n).cast("double"), 5).alias(n) for n in FEATURES]
    )


@query(
    "c19_unknown_types",
    """SELECT type, CAST(CASE WHEN type = 'WIRE' OR type IS NULL THEN 0 ELSE 1 END AS BIGINT) AS one_hot_total, count(*) AS row_count
       FROM (SELECT CASE WHEN txn_id%113=0 THEN 'WIRE' ELSE type END AS type FROM txn) GROUP BY type""",
)
def c19(spark: SparkSession, d: str) -> DataFrame:
    """Unknown types give an all-zero one-hot when they are allowed."""
    rows = txn(spark, d).withColumn(
        "type", F.when(F.col("txn_id") % 113 == 0, "WIRE").otherwise(F.col("type"))
    )
    made = add_features(rows, keep=["type"], allow_unknown_types=True)
    hot = sum((F.col(n) for n in FEATURES if n.startswith("type_")), F.lit(0.0))
    return (
        made.groupBy("type", hot.cast("bigint").alias("one_hot_total"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select("type", "one_hot_total", "row_count")
    )


@query(
    "c20_feature_groups",
    FEATURES_CTE
    + ", m AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS feature, avg({n}) AS mean FROM feats" for n in FEATURES)
    + "), g(feature_group, feature) AS (VALUES "
    + ", ".join(f"('{g}', '{n}')" for g, names in FEATURE_GROUPS.items() for n in names)
    + ") SELECT g.feature_group, g.feature, round(m.mean, 4) AS mean FROM g JOIN m ON g.feature = m.feature",
)
def c20(spark: SparkSession, d: str) -> DataFrame:
    """Means of the features of each ablation group."""
    means = add_features(txn(spark, d)).agg(*[F.avg(n).alias(n) for n in FEATURES])
    groups = F.array(
        *[
            F.struct(F.lit(g).alias("feature_group"), F.lit(n).alias("feature"), F.col(n).alias("mean"))
            for g, names in FEATURE_GROUPS.items()
            for n in names
        ]
    )
    return rounded(means.select(F.inline(groups)), 4)


@query("d1_step_histogram", "SELECT step, c AS row_count, CAST(f AS BIGINT) AS fraud_count FROM hist")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return chrono.step_histogram(txn(spark, d))


@query(
    "d2_cumulative_steps",
    "SELECT step, CAST(cc AS BIGINT) AS rows_upto, rn AS steps_upto FROM cum",
)
def d2(spark: SparkSession, d: str) -> DataFrame:
    return chrono.cumulative_steps(txn(spark, d)).select("step", "rows_upto", "steps_upto")


@query("d3_boundaries", "SELECT tb AS train_validation, vb AS validation_test FROM tbound, vbound")
def d3(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    bounds = chrono.choose_boundaries(rows)
    return rows.agg(
        F.max(F.when(F.col("step") <= bounds.train, F.col("step"))).alias("train_validation"),
        F.max(F.when(F.col("step") <= bounds.validation, F.col("step"))).alias("validation_test"),
    )


@query(
    "d4_split_checks",
    """+ s AS (SELECT split, min(step) AS lo, max(step) AS hi, count(*) AS n, sum(isFraud) AS f FROM splits GROUP BY split)
       SELECT 'total_row_conservation' AS check_name, (SELECT sum(n) FROM s) = (SELECT count(*) FROM txn) AS passed
       UNION ALL SELECT 'total_fraud_conservation', (SELECT sum(f) FROM s) = (SELECT sum(isFraud) FROM txn)
       UNION ALL SELECT 'no_step_overlap', (SELECT count(*) FROM (SELECT step FROM splits GROUP BY step HAVING count(DISTINCT split) > 1)) = 0
       UNION ALL SELECT 'chronological_ordering_check', (SELECT max(hi) FROM s WHERE split='train') < (SELECT min(lo) FROM s WHERE split='validation')
                  AND (SELECT max(hi) FROM s WHERE split='validation') < (SELECT min(lo) FROM s WHERE split='test')
       UNION ALL SELECT 'class_coverage_check', (SELECT count(*) FROM s WHERE f > 0 AND n > f) = 3""",
)
def d4(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    bounds = chrono.choose_boundaries(rows)
    return chrono.split_checks(rows, rows.withColumn("split", bounds.split(F.col("step"))))


@query(
    "d5_split_summary",
    """SELECT split, min(step) AS step_minimum, max(step) AS step_maximum, count(*) AS row_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
       CAST(count(*)-sum(isFraud) AS BIGINT) AS non_fraud_count, round(sum(isFraud)/CAST(count(*) AS DOUBLE)*100, 6) AS fraud_percentage,
       round(count(*)/CAST((SELECT count(*) FROM txn) AS DOUBLE), 6) AS actual_fraction FROM splits GROUP BY split""",
)
def d5(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    return rounded(chrono.split_summary(rows, chrono.choose_boundaries(rows)))


@query(
    "d6_inner_split",
    """+ x AS (SELECT CASE WHEN step <= ib THEN 'inner_fit' ELSE 'inner_tuning' END AS period, step, isFraud FROM train, ibound)
       SELECT period, min(step) AS step_minimum, max(step) AS step_maximum, count(*) AS row_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
       round(sum(isFraud)/CAST(count(*) AS DOUBLE)*100, 6) AS fraud_percentage FROM x GROUP BY period""",
)
def d6(spark: SparkSession, d: str) -> DataFrame:
    """D6, D7."""
    train = train_of(txn(spark, d))
    return rounded(chrono.period_counts(train, chrono.inner_windows(train)))


_NEGATIVE_SAMPLE = """+ pick AS (SELECT txn_id FROM {source} WHERE isFraud=0
          ORDER BY substr(sha256('42:' || CAST(txn_id AS VARCHAR)), 1, 15), txn_id LIMIT {n}),
       smp AS (SELECT t.* FROM {source} t WHERE isFraud=1 OR txn_id IN (SELECT txn_id FROM pick))
"""


@query(
    "d8_profile_sample",
    _NEGATIVE_SAMPLE.format(source="train", n=2000) + "SELECT txn_id, isFraud FROM smp",
)
def d8(spark: SparkSession, d: str) -> DataFrame:
    return sampling.profile_sample(train_of(txn(spark, d)), 2000).select("txn_id", "isFraud")


@query(
    "d9_weighted_sample",
    _NEGATIVE_SAMPLE.format(source="train", n=3000)
    + """SELECT txn_id, isFraud, round(CASE WHEN isFraud=1 THEN 1.0 ELSE (SELECT count(*) FROM train WHERE isFraud=0)/
           CAST(least(3000, (SELECT count(*) FROM train WHERE isFraud=0)) AS DOUBLE) END, 6) AS weight FROM smp""",
)
def d9(spark: SparkSession, d: str) -> DataFrame:
    sample = sampling.weighted_sample(train_of(txn(spark, d)), 3000)
    return rounded(sample.select("txn_id", "isFraud", "weight"))


@query(
    "d10_sample_metadata",
    _NEGATIVE_SAMPLE.format(source="train", n=3000)
    + """, o AS (SELECT count(*) AS n, sum(isFraud) AS f FROM train), k AS (SELECT count(*) AS n, sum(isFraud) AS f FROM smp)
       SELECT o.n AS original_rows, CAST(o.f AS BIGINT) AS original_fraud_rows, CAST(o.n-o.f AS BIGINT) AS original_nonfraud_rows,
         CAST(k.f AS BIGINT) AS sampled_fraud_rows, CAST(k.n-k.f AS BIGINT) AS sampled_nonfraud_rows,
         round(k.f/CAST(o.f AS DOUBLE), 6) AS fraud_sampling_fraction, round((k.n-k.f)/CAST(o.n-o.f AS DOUBLE), 6) AS nonfraud_sampling_fraction,
         CAST(1.0 AS DOUBLE) AS fraud_weight, round((o.n-o.f)/CAST(k.n-k.f AS DOUBLE), 6) AS nonfraud_weight,
         k.f = o.f AS all_frauds_kept, TRUE AS weight_matches_counts FROM o, k""",
)
def d10(spark: SparkSession, d: str) -> DataFrame:
    train = train_of(txn(spark, d))
    return rounded(sampling.sample_metadata(train, sampling.weighted_sample(train, 3000)))


@query(
    "d11_balanced_weights",
    """SELECT isFraud AS label, count(*) AS class_count,
       round((SELECT count(*) FROM train)/CAST(2*count(*) AS DOUBLE), 6) AS weight FROM train GROUP BY isFraud""",
)
def d11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.balanced_weights(train_of(txn(spark, d))))


@query(
    "d12_positive_weight",
    "SELECT isFraud, count(*) AS row_count, CAST(sum(CASE WHEN isFraud=1 THEN 5 ELSE 1 END) AS DOUBLE) AS weight FROM train GROUP BY isFraud",
)
def d12(spark: SparkSession, d: str) -> DataFrame:
    rows = train_of(txn(spark, d)).withColumn("w", sampling.positive_weight(5.0))
    return rows.groupBy("isFraud").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("w").alias("weight")
    )


@query(
    "d13_label_permutation",
    """+ pick AS (SELECT txn_id FROM train ORDER BY substr(sha256('1000045:' || CAST(txn_id AS VARCHAR)), 1, 15), txn_id
          LIMIT (SELECT sum(isFraud) FROM train))
       SELECT txn_id, CASE WHEN txn_id IN (SELECT txn_id FROM pick) THEN 1 ELSE 0 END AS isFraud FROM train""",
)
def d13(spark: SparkSession, d: str) -> DataFrame:
    return sampling.permuted_labels(train_of(txn(spark, d))).select("txn_id", "isFraud")


@query(
    "e1_class_balance",
    """SELECT count(*) AS row_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count, CAST(count(*)-sum(isFraud) AS BIGINT) AS non_fraud_count,
       round(sum(isFraud)/CAST(count(*) AS DOUBLE)*100, 6) AS fraud_percentage FROM train""",
)
def e1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.class_balance(train_of(txn(spark, d))))


@query(
    "e2_fraud_by_type",
    """SELECT type, count(*) AS transaction_count, CAST(nullif(sum(isFraud), 0) AS BIGINT) AS fraud_count,
       round(sum(isFraud)/CAST(count(*) AS DOUBLE)*100, 6) AS fraud_rate FROM train GROUP BY type""",
)
def e2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.fraud_by_type(train_of(txn(spark, d))))


@query(
    "e3_fraud_by_step",
    """SELECT step, count(*) AS row_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
       round(sum(isFraud)/CAST(count(*) AS DOUBLE)*100, 6) AS fraud_rate FROM train GROUP BY step""",
)
def e3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.fraud_by_step(train_of(txn(spark, d))))


@query(
    "e4_amount_statistics",
    """SELECT isFraud AS label, count(amount) AS row_count, min(amount) AS minimum, max(amount) AS maximum, round(avg(amount), 6) AS mean,
       round(coalesce(stddev_samp(amount), 0), 6) AS standard_deviation FROM train GROUP BY isFraud""",
)
def e4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.amount_statistics(train_of(txn(spark, d))))


@query(
    "e5_balance_statistics",
    " UNION ALL ".join(
        f"""SELECT isFraud AS label, '{c}' AS column_name, count({c}) AS row_count, round(min({c}), 4) AS minimum,
            round(max({c}), 4) AS maximum, round(avg({c}), 4) AS mean FROM train GROUP BY isFraud"""
        for c in ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")
    ),
)
def e5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.balance_statistics(train_of(txn(spark, d))), 4)


@query(
    "e6_flag_crosstab",
    "SELECT isFlaggedFraud AS flagged, isFraud AS fraud, count(*) AS row_count FROM train GROUP BY 1, 2",
)
def e6(spark: SparkSession, d: str) -> DataFrame:
    return profile.flag_crosstab(train_of(txn(spark, d)))


@query(
    "e7_zero_balances",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c}=0) AS zero_count,
            round(count(*) FILTER (WHERE {c}=0)/CAST(count(*) AS DOUBLE)*100, 6) AS percentage FROM train"""
        for c in ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")
    ),
)
def e7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.zero_balances(train_of(txn(spark, d))))


@query(
    "e8_amount_histogram",
    """+ s AS (SELECT isFraud AS label, min(amount) AS lo, max(amount) AS hi FROM train WHERE amount > 0 GROUP BY 1)
       SELECT x.isFraud AS label, CAST(least(floor((x.amount-s.lo)/((s.hi-s.lo)/CAST(50 AS DOUBLE))), 49) AS INT) AS bin, count(*) AS row_count
       FROM train x JOIN s ON x.isFraud = s.label WHERE x.amount > 0 GROUP BY 1, 2""",
)
def e8(spark: SparkSession, d: str) -> DataFrame:
    return profile.amount_histogram(train_of(txn(spark, d)))


@query(
    "e9_hour_histogram",
    """SELECT period, (step-1)%24 AS hour, count(*) AS row_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count
       FROM periods GROUP BY 1, 2""",
)
def e9(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    return profile.hour_histogram(rows, periods_of(rows))


@query(
    "e10_type_histogram",
    "SELECT period, type, count(*) AS row_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count FROM periods GROUP BY 1, 2",
)
def e10(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    return profile.type_histogram(rows, periods_of(rows))


@query(
    "e11_balance_gap",
    """SELECT period, isFraud AS label, round(quantile_cont(abs(oldbalanceOrg-amount), 0.5), 6) AS median,
       round(quantile_cont(abs(oldbalanceOrg-amount), 0.95), 6) AS p95 FROM periods GROUP BY 1, 2""",
)
def e11(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    return rounded(profile.balance_gap(rows, periods_of(rows)))


@query(
    "e12_balance_ratio",
    """SELECT period, isFraud AS label, round(quantile_cont(amount/(oldbalanceOrg+1), 0.5), 6) AS median,
       round(quantile_cont(amount/(oldbalanceOrg+1), 0.95), 6) AS p95 FROM periods GROUP BY 1, 2""",
)
def e12(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    return rounded(profile.balance_ratio(rows, periods_of(rows)))
