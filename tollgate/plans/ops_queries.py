"""Registered queries for the ledger, monitoring, trailing windows and series (I-L)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators import drift, ledger, series, trailing
from tollgate.plans.core_queries import WINDOW_END, WINDOW_START, train_of
from tollgate.plans.registry import marked_text, query, rounded, txn
from tollgate.sources import canonical


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def stamped(df: DataFrame) -> DataFrame:
    """Timestamps as text to the second."""
    return df.select(
        *[stamp(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    )


_LANES = ", ".join(
    f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR) AS lane{i}" for i in range(4)
)


@query(
    "i1_payload_hashes",
    f"""+ h AS (SELECT request_id, md5(concat_ws('#', {', '.join(map(marked_text, ["item_index", "step", "transaction_type", "amount", "oldbalance_origin", "oldbalance_destination"]))})) AS h FROM predictions),
       g AS (SELECT request_id, count(*) AS n, {_LANES} FROM h GROUP BY request_id)
       SELECT g.request_id, sha256(concat_ws('#', r.endpoint, g.n, lane0, lane1, lane2, lane3)) AS payload_hash
       FROM g JOIN requests r ON g.request_id = r.request_id""",
)
def i1(spark: SparkSession, d: str) -> DataFrame:
    preds = canonical.predictions(txn(spark, d))
    return ledger.payload_hashes(preds, canonical.requests(preds))


@query(
    "i2_intake",
    """+ f AS (SELECT request_id, arg_min(amount, attempt) AS a0, min(attempt) AS t0 FROM attempts GROUP BY request_id)
       SELECT a.request_id, a.attempt, CASE WHEN a.amount <> f.a0 THEN 'conflict' WHEN a.attempt = f.t0 THEN 'new' ELSE 'replay' END AS status
       FROM attempts a JOIN f ON a.request_id = f.request_id""",
)
def i2(spark: SparkSession, d: str) -> DataFrame:
    attempts = canonical.intake_attempts(txn(spark, d))
    return ledger.classify_attempts(attempts, payload="amount").select(
        "request_id", "attempt", "status"
    )


@query(
    "i3_materialised_events",
    """SELECT request_id, item_index, transaction_type AS type, round(amount, 2) AS amount, round(1/(1+exp(-(amount/100-2))), 6) AS fraud_score,
       CASE WHEN 1/(1+exp(-(amount/100-2))) >= CAST(0.98310834 AS DOUBLE) THEN 'high' WHEN 1/(1+exp(-(amount/100-2))) >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level
       FROM predictions""",
)
def i3(spark: SparkSession, d: str) -> DataFrame:
    from tollgate.functions.exprs import risk_level
    from tollgate.schemas import MODEL_INPUTS

    rows = txn(spark, d)
    items = F.struct(*[F.col(c) for c in MODEL_INPUTS])
    asked = rows.groupBy((F.col("txn_id") - F.col("txn_id") % 3).alias("request_id")).agg(
        F.min("ts").alias("created_at"),
        F.array_compact(
            F.array(*[F.max(F.when(F.col("txn_id") % 3 == i, items)) for i in range(3)])
        ).alias("transactions"),
    )
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("amount") / 100 - 2)))
    made = ledger.materialise_events(asked, score, risk_level(F.col("fraud_score")))
    return rounded(
        made.select("request_id", "item_index", "type", "amount", "fraud_score", "risk_level"),
        6,
        amount=2,
    )


@query(
    "i4_stored_results",
    """SELECT request_id, item_index, prediction_id, risk_level
       FROM predictions p WHERE EXISTS (SELECT 1 FROM (SELECT request_id, count(*) AS n, max(item_index) AS hi FROM predictions WHERE prediction_id%50<>1 GROUP BY 1) e
         JOIN requests r ON e.request_id = r.request_id WHERE e.request_id = p.request_id AND e.n = r.batch_size AND e.hi = r.batch_size-1)""",
)
def i4(spark: SparkSession, d: str) -> DataFrame:
    preds = canonical.predictions(txn(spark, d))
    kept = preds.where(F.col("prediction_id") % 50 != 1)
    made = ledger.stored_results(canonical.requests(preds), kept)
    return made.select("request_id", "item_index", "prediction_id", "risk_level")


@query(
    "i5_audit_records",
    """SELECT p.prediction_id, p.request_id, p.item_index, r.endpoint, r.batch_size, p.prediction, p.risk_level, o.actual_fraud, o.source,
       strftime(o.observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at
       FROM predictions p JOIN requests r ON p.request_id = r.request_id LEFT JOIN outcomes o ON p.prediction_id = o.prediction_id""",
)
def i5(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    preds = canonical.predictions(rows)
    made = ledger.audit_records(preds, canonical.requests(preds), canonical.outcomes(rows))
    return stamped(
        made.select(
            "prediction_id", "request_id", "item_index", "endpoint", "batch_size", "prediction",
            "risk_level", "actual_fraud", "source", "observed_at",
        )
    )


# Batches are walked in order: one that clashes with an earlier sound batch is refused unless all
# of those were refused themselves.
_ADMIT = """+ fl AS (SELECT batch_id, prediction_id, arg_min(actual_fraud, "position") AS lab FROM submissions GROUP BY 1, 2),
  j AS (SELECT s.*, fl.lab, p.prediction_id IS NOT NULL AS known, st.actual_fraud AS had FROM submissions s
        JOIN fl ON s.batch_id = fl.batch_id AND s.prediction_id = fl.prediction_id
        LEFT JOIN predictions p ON s.prediction_id = p.prediction_id LEFT JOIN stored st ON s.prediction_id = st.prediction_id),
  ad AS (SELECT batch_id, count(*) AS submissions, count(*) FILTER (WHERE NOT known) AS unknown_ids, count(*) FILTER (WHERE actual_fraud <> lab) AS label_conflicts,
           count(*) FILTER (WHERE had IS NOT NULL AND actual_fraud <> had) AS stored_conflicts, count(*) > 1000 AS oversize, min("position") AS o FROM j GROUP BY batch_id),
  so AS (SELECT batch_id, row_number() OVER (ORDER BY o) AS k FROM ad WHERE unknown_ids = 0 AND label_conflicts = 0 AND stored_conflicts = 0 AND NOT oversize),
  sl AS (SELECT so.k, s.prediction_id, s.actual_fraud, count(*) AS n FROM submissions s JOIN so ON s.batch_id = so.batch_id GROUP BY 1, 2, 3),
  cl AS (SELECT b.k AS b, a.k AS a, b.prediction_id, b.n FROM sl a JOIN sl b ON a.prediction_id = b.prediction_id AND a.actual_fraud <> b.actual_fraud AND a.k < b.k),
  bl AS (SELECT b, list(DISTINCT a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM cl GROUP BY b),
  wk AS (WITH RECURSIVE w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS refused
           UNION ALL SELECT bl.i, CASE WHEN list_has_all(w.refused, bl.earlier) THEN w.refused ELSE list_append(w.refused, bl.b) END FROM w JOIN bl ON bl.i = w.i + 1)
         SELECT refused FROM w ORDER BY i DESC LIMIT 1),
  ec AS (SELECT b, sum(n) AS late FROM (SELECT DISTINCT b, prediction_id, n FROM cl WHERE NOT list_contains((SELECT refused FROM wk), a)) GROUP BY b),
  adm AS (SELECT ad.batch_id, submissions, unknown_ids, label_conflicts, stored_conflicts, CAST(coalesce(ec.late, 0) AS BIGINT) AS earlier_conflicts, oversize,
            so.k IS NOT NULL AND ec.late IS NULL AS admitted FROM ad LEFT JOIN so ON ad.batch_id = so.batch_id LEFT JOIN ec ON so.k = ec.b)
"""


def _admission(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    sent, known = canonical.outcome_submissions(rows), canonical.predictions(rows)
    stored = canonical.stored_outcomes(rows)
    return sent, ledger.admit_batches(sent, known, stored), stored


@query("i6_outcome_admission", _ADMIT + "SELECT * FROM adm")
def i6(spark: SparkSession, d: str) -> DataFrame:
    return _admission(txn(spark, d))[1]


@query(
    "i7_outcome_merge",
    _ADMIT
    + """, acc AS (SELECT s.* FROM submissions s JOIN adm ON s.batch_id = adm.batch_id WHERE adm.admitted),
       r AS (SELECT acc.*, min("position") OVER (PARTITION BY prediction_id) AS p0 FROM acc)
       SELECT r.batch_id, r."position", r.prediction_id, r.actual_fraud, r.source,
              r.prediction_id IN (SELECT prediction_id FROM stored) OR r."position" <> r.p0 AS replayed FROM r""",
)
def i7(spark: SparkSession, d: str) -> DataFrame:
    sent, admitted, stored = _admission(txn(spark, d))
    return ledger.merge_outcomes(sent, admitted, stored).select(
        "batch_id", "position", "prediction_id", "actual_fraud", "source", "replayed"
    )


@query(
    "i8_row_counts",
    """SELECT 'prediction_requests' AS table_name, count(*) AS row_count FROM requests UNION ALL SELECT 'prediction_events', count(*) FROM predictions
       UNION ALL SELECT 'prediction_outcomes', count(*) FROM outcomes""",
)
def i8(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    preds = canonical.predictions(rows)
    return ledger.row_counts(
        {
            "prediction_requests": canonical.requests(preds),
            "prediction_events": preds,
            "prediction_outcomes": canonical.outcomes(rows),
        }
    )


@query(
    "i9_lookup",
    "SELECT prediction_id, prediction, risk_level FROM predictions WHERE prediction_id IN (SELECT DISTINCT o_custkey FROM orders)",
)
def i9(spark: SparkSession, d: str) -> DataFrame:
    """Ids asked for repeatedly, as another table names them."""
    asked = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").alias("prediction_id")
    )
    found = ledger.lookup(canonical.predictions(txn(spark, d)), asked)
    return found.select("prediction_id", "prediction", "risk_level")


_FEATURE_OF = {
    "step": "CAST(step AS DOUBLE)",
    "log1p(amount)": "ln(1+amount)",
    "log1p(oldbalanceOrg)": "ln(1+oldbalanceOrg)",
    "log1p(oldbalanceDest)": "ln(1+oldbalanceDest)",
}
_EVENT_OF = {
    "step": "CAST(step AS DOUBLE)",
    "log1p(amount)": "ln(1+amount)",
    "log1p(oldbalanceOrg)": "ln(1+oldbalance_origin)",
    "log1p(oldbalanceDest)": "ln(1+oldbalance_destination)",
}


def _long(exprs: dict[str, str], table: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{f}' AS feature, {e} AS x FROM {table}" for f, e in exprs.items()
    )


_TENTHS = ", ".join(f"CAST({i / 10} AS DOUBLE)" for i in range(11))
# Bucket = inner edges <= x. A hair is taken off the edges, because ln(1+x) and log1p differ in
# the last digit between engines; no other value lies that close.
_DRIFT_CTE = f"""+ tl AS ({_long(_FEATURE_OF, "train")}),
  qe AS (SELECT feature, quantile_cont(x, [{_TENTHS}]) AS e FROM tl GROUP BY feature),
  edges AS (SELECT feature, list_sort(list_distinct(e)) AS e FROM qe),
  tb AS (SELECT tl.feature, len(list_filter(e[2:len(e)-1], lambda z: z <= x + 1e-9)) AS bucket FROM tl JOIN edges ON tl.feature = edges.feature),
  cats AS (SELECT type, CAST(row_number() OVER (ORDER BY type) - 1 AS INT) AS bucket, count(*) AS n FROM train GROUP BY type),
  refn AS (SELECT feature, bucket, count(*) AS n FROM tb GROUP BY 1, 2 UNION ALL SELECT 'type', bucket, n FROM cats
           UNION ALL SELECT 'type', (SELECT count(*) FROM cats), 0),
  ref AS (SELECT feature, bucket, n, n/CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS prop FROM refn)
"""


def _psi_cte(name: str, start: str, end: str) -> str:
    return f""", ev_{name} AS (SELECT * FROM predictions WHERE created_at >= TIMESTAMP '{start}' AND created_at < TIMESTAMP '{end}'),
  cl_{name} AS ({_long(_EVENT_OF, "ev_" + name)}),
  cb_{name} AS (SELECT c.feature, len(list_filter(e[2:len(e)-1], lambda z: z <= x + 1e-9)) AS bucket FROM cl_{name} c JOIN edges ON c.feature = edges.feature
            UNION ALL SELECT 'type', coalesce(cats.bucket, (SELECT count(*) FROM cats)) FROM ev_{name} v LEFT JOIN cats ON v.transaction_type = cats.type),
  cn_{name} AS (SELECT feature, bucket, count(*) AS n FROM cb_{name} GROUP BY 1, 2),
  px_{name} AS (SELECT ref.feature, ref.bucket, greatest(ref.prop, 1e-6) AS r, coalesce(c.n, 0) AS n,
             CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY ref.feature) AS DOUBLE) AS size FROM ref LEFT JOIN cn_{name} c ON ref.feature = c.feature AND ref.bucket = c.bucket),
  psi_{name} AS (SELECT feature, CAST(max(size) AS BIGINT) AS sample_size,
             CASE WHEN max(size) >= 20 THEN greatest(0, sum((greatest(n/size, 1e-6)-r)*ln(greatest(n/size, 1e-6)/r))) END AS psi FROM px_{name} GROUP BY feature),
  sev_{name} AS (SELECT *, CASE WHEN psi IS NULL THEN 'insufficient_data' WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS severity FROM psi_{name})
"""


def _output_sql(rows: str, prefix: str) -> str:
    parts = [
        ("alert_rate", "NULL", "count(*) FILTER (WHERE prediction=1)/CAST(nullif(count(*), 0) AS DOUBLE)"),
        ("mean_fraud_score", "NULL", "avg(fraud_score)"),
    ]
    parts += [
        ("prediction_distribution", f"'{v}'", f"count(*) FILTER (WHERE prediction={v})/CAST(nullif(count(*), 0) AS DOUBLE)")
        for v in (0, 1)
    ]
    parts += [
        ("risk_level_distribution", f"'{v}'", f"count(*) FILTER (WHERE risk_level='{v}')/CAST(nullif(count(*), 0) AS DOUBLE)")
        for v in ("low", "medium", "high")
    ]
    return " UNION ALL ".join(
        f"SELECT '{prefix}{n}' AS metric_name, CAST({f} AS VARCHAR) AS feature_name, {v} AS metric_value, count(*) AS sample_size FROM {rows}"
        for n, f, v in parts
    )


def _performance_cte(name: str) -> str:
    return f""", lab_{name} AS (SELECT v.prediction AS pd, o.actual_fraud AS ac, v.amount FROM ev_{name} v JOIN outcomes o ON v.prediction_id = o.prediction_id),
  pc_{name} AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE pd=1 AND ac=1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE pd=1 AND ac=0) AS DOUBLE) AS fp,
             CAST(count(*) FILTER (WHERE pd=0 AND ac=1) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE pd=0 AND ac=0) AS DOUBLE) AS tn,
             coalesce(sum(CASE WHEN ac=1 AND pd=1 THEN amount ELSE 0 END), 0) AS caught, coalesce(sum(CASE WHEN ac=1 THEN amount ELSE 0 END), 0) AS money FROM lab_{name}),
  pr_{name} AS (SELECT *, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS pre, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END AS rec FROM pc_{name}),
  pf_{name} AS (SELECT n, pre AS "precision", rec AS recall, CASE WHEN pre+rec>0 THEN 2*pre*rec/(pre+rec) ELSE 0 END AS f1,
             CASE WHEN 4*pre+rec>0 THEN 5*pre*rec/(4*pre+rec) ELSE 0 END AS f2, CASE WHEN fp+tn>0 THEN fp/(fp+tn) ELSE 0 END AS false_positive_rate,
             CASE WHEN money>0 THEN caught/money ELSE 0 END AS fraud_amount_recall FROM pr_{name})
"""


def _metrics_sql(name: str, before: str) -> str:
    perf = " UNION ALL ".join(
        f"""SELECT '{m}', NULL, "{m}", n FROM pf_{name} WHERE n >= 20""" for m in drift.PERFORMANCE_METRICS
    )
    return f"""SELECT metric_name, feature_name, round(metric_value, 6) AS metric_value,
         CASE WHEN metric_value IS NULL THEN 'unavailable' ELSE 'informational' END AS severity, sample_size FROM (
           {_output_sql("ev_" + name, "")} UNION ALL {_output_sql("ev_" + before, "previous_window_")}
           UNION ALL SELECT 'performance_available', NULL, CASE WHEN n >= 20 THEN 1.0 ELSE 0.0 END, n FROM pf_{name} UNION ALL {perf})
       UNION ALL SELECT 'feature_psi', feature, round(psi, 6), severity, sample_size FROM sev_{name}"""


_NOW = ("2024-01-30 00:00:00", "2024-01-31 00:00:00")
_BEFORE = ("2024-01-29 00:00:00", "2024-01-30 00:00:00")


def _profile(rows: DataFrame) -> drift.ReferenceProfile:
    return drift.freeze_profile(train_of(rows))


def _current(rows: DataFrame) -> DataFrame:
    return ledger.window_events(
        canonical.predictions(rows), canonical.outcomes(rows), WINDOW_START, WINDOW_END
    )


@query(
    "j1_reference_profile",
    _DRIFT_CTE
    + """SELECT feature, CAST(bucket AS INT) AS bucket, n AS ref_count, round(prop, 6) AS ref_prop FROM ref""",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    """J1, J2, J3."""
    frame = _profile(txn(spark, d)).to_frame(spark)
    return rounded(frame.select("feature", "bucket", "ref_count", "ref_prop"))


@query(
    "j1_quantile_edges",
    _DRIFT_CTE
    + "SELECT feature, CAST(i AS INT) AS edge, round(e[i+1], 6) AS value FROM qe, (SELECT unnest(range(0, 11)) AS i)",
)
def j1_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = drift.quantile_edges(train_of(txn(spark, d)))
    return rounded(edges.select("feature", F.posexplode("edges").alias("edge", "value")))


_PSI_NOW = _DRIFT_CTE + _psi_cte("now", *_NOW)


@query(
    "j4_feature_psi",
    _PSI_NOW + "SELECT feature, sample_size, round(psi, 6) AS psi, severity FROM sev_now",
)
def j4(spark: SparkSession, d: str) -> DataFrame:
    """J3 to J8 on the current window."""
    rows = txn(spark, d)
    made = drift.feature_drift(_current(rows), _profile(rows), columns=drift.EVENT_COLUMN)
    return rounded(made)


@query(
    "j9_overall_drift",
    _PSI_NOW
    + """SELECT severity AS overall_drift_status FROM sev_now
       ORDER BY CASE severity WHEN 'significant' THEN 3 WHEN 'moderate' THEN 2 WHEN 'stable' THEN 1 ELSE 0 END DESC LIMIT 1""",
)
def j9(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    return drift.overall_drift(
        drift.feature_drift(_current(rows), _profile(rows), columns=drift.EVENT_COLUMN)
    )


_EV = "+ z AS (SELECT 1)" + "".join(
    f""", ev_{n} AS (SELECT * FROM predictions WHERE created_at >= TIMESTAMP '{s}' AND created_at < TIMESTAMP '{e}')"""
    for n, (s, e) in {"now": _NOW, "before": _BEFORE}.items()
)


@query(
    "j10_output_metrics",
    _EV
    + f"""SELECT metric_name, feature_name, round(metric_value, 6) AS metric_value, 'informational' AS severity, sample_size FROM (
         {_output_sql("ev_now", "")} UNION ALL {_output_sql("ev_before", "previous_window_")})""".replace("SELECT metric_name", " SELECT metric_name", 1),
)
def j10(spark: SparkSession, d: str) -> DataFrame:
    """J10, J11."""
    events = canonical.predictions(txn(spark, d))
    previous, start, end = drift.window_bounds(WINDOW_END, 24)
    at = {t: ledger.time_literal(events, "created_at", t) for t in (previous, start, end)}
    created = F.col("created_at")
    both = events.where((created >= at[previous]) & (created < at[end]))
    return rounded(
        drift.output_metrics(
            both, {"": created >= at[start], "previous_window_": created < at[start]}
        )
    )


@query(
    "j12_performance",
    _EV
    + _performance_cte("now")
    + """SELECT CASE WHEN n >= 20 THEN 'available' ELSE 'insufficient_labeled_data' END AS status, n AS labeled_count, round("precision", 6) AS "precision",
       round(recall, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS f2, round(false_positive_rate, 6) AS false_positive_rate,
       round(fraud_amount_recall, 6) AS fraud_amount_recall FROM pf_now""",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(drift.performance(_current(txn(spark, d))))


@query(
    "j13_run_summary",
    _PSI_NOW
    + _performance_cte("now")
    + """SELECT '2024-01-30 00:00:00' AS window_start, '2024-01-31 00:00:00' AS window_end, 'train_v1' AS reference_version,
         (SELECT count(*) FROM ev_now) AS event_count, (SELECT n FROM pf_now) AS labeled_count,
         CASE WHEN (SELECT count(*) FROM ev_now) < 20 THEN 'insufficient_data' WHEN (SELECT n FROM pf_now) < 20 THEN 'insufficient_labeled_data' ELSE 'completed' END AS status,
         (SELECT severity FROM sev_now ORDER BY CASE severity WHEN 'significant' THEN 3 WHEN 'moderate' THEN 2 WHEN 'stable' THEN 1 ELSE 0 END DESC LIMIT 1) AS overall_drift_status""",
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    metrics = drift.monitoring_metrics(
        canonical.predictions(rows), canonical.outcomes(rows), _profile(rows), WINDOW_END
    )
    return drift.run_summary(metrics, WINDOW_END)


_METRICS_NOW = (
    _PSI_NOW
    + f", ev_before AS (SELECT * FROM predictions WHERE created_at >= TIMESTAMP '{_BEFORE[0]}' AND created_at < TIMESTAMP '{_BEFORE[1]}')"
    + _performance_cte("now")
)


@query("j14_monitoring_metrics", _METRICS_NOW + _metrics_sql("now", "before"))
def j14(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    return rounded(
        drift.monitoring_metrics(
            canonical.predictions(rows), canonical.outcomes(rows), _profile(rows), WINDOW_END
        )
    )


@query(
    "j15_latest_state",
    _METRICS_NOW
    + f""", m AS ({_metrics_sql("now", "before")})
       SELECT 'run_status' AS gauge, CASE WHEN (SELECT n FROM pf_now) < 20 THEN 'insufficient_labeled_data' ELSE 'completed' END AS label, 1.0 AS value
       UNION ALL SELECT 'window_events', NULL, count(*) FROM ev_now UNION ALL SELECT 'labeled_events', NULL, n FROM pf_now
       UNION ALL SELECT 'last_success', '2024-01-31 00:00:00', 1.0
       UNION ALL SELECT metric_name, feature_name, metric_value FROM m WHERE metric_value IS NOT NULL
         AND metric_name IN ('feature_psi','alert_rate','mean_fraud_score','performance_available','precision','recall','f1','f2','false_positive_rate','fraud_amount_recall')
       UNION ALL SELECT 'feature_drift_severity', feature || ':' || severity, 1.0 FROM sev_now""",
)
def j15(spark: SparkSession, d: str) -> DataFrame:
    """State after two daily runs; the newest decides."""
    rows = txn(spark, d)
    profile = _profile(rows)
    runs = metrics = None
    for end in (WINDOW_END - timedelta(days=1), WINDOW_END):
        m = drift.monitoring_metrics(
            canonical.predictions(rows), canonical.outcomes(rows), profile, end
        )
        r = drift.run_summary(m, end)
        m = m.withColumn("window_end", F.lit(end.strftime("%Y-%m-%d %H:%M:%S")))
        runs = r if runs is None else runs.unionByName(r)
        metrics = m if metrics is None else metrics.unionByName(m)
    return rounded(drift.latest_state(runs, metrics))


_MINUTES = (
    _DRIFT_CTE
    + """, pl AS (SELECT prediction_id, date_trunc('minute', created_at) AS minute, """
    + ", ".join(f'{e} AS "{f}"' for f, e in _EVENT_OF.items())
    + """, transaction_type, prediction, risk_level, fraud_score FROM predictions),
  nb AS ("""
    + " UNION ALL ".join(
        f"""SELECT minute, '{f}' AS series, CAST(len(list_filter(e[2:len(e)-1], lambda z: z <= pl."{f}" + 1e-9)) AS VARCHAR) AS bucket, CAST(1 AS DOUBLE) AS v FROM pl, edges WHERE edges.feature = '{f}'"""
        for f in _EVENT_OF
    )
    + """ UNION ALL SELECT minute, 'type', CAST(coalesce(cats.bucket, (SELECT count(*) FROM cats)) AS VARCHAR), 1 FROM pl LEFT JOIN cats ON pl.transaction_type = cats.type
      UNION ALL SELECT minute, 'prediction', CAST(prediction AS VARCHAR), 1 FROM pl UNION ALL SELECT minute, 'risk_level', risk_level, 1 FROM pl
      UNION ALL SELECT minute, 'fraud_score', 'sum', fraud_score FROM pl),
  mt AS (SELECT minute, series, bucket, count(*) AS n, sum(v) AS total FROM nb GROUP BY 1, 2, 3)
"""
)


def _minute_totals(rows: DataFrame) -> DataFrame:
    return trailing.minute_totals(
        canonical.predictions(rows), _profile(rows), F.date_trunc("minute", "created_at").cast("timestamp_ntz")
    )


@query(
    "k5_minute_totals",
    _MINUTES
    + "SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, series, bucket, n, round(total, 6) AS total FROM mt",
)
def k5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stamped(_minute_totals(txn(spark, d))))


@query(
    "k6_trailing_windows",
    _MINUTES
    + """, we AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 6 HOUR)) AS window_end),
       ks AS (SELECT DISTINCT series, bucket FROM mt)
       SELECT ks.series, ks.bucket, strftime(we.window_end, '%Y-%m-%d %H:%M:%S') AS window_end, CAST(coalesce(sum(mt.n), 0) AS BIGINT) AS n,
         round(coalesce(sum(mt.total), 0), 4) AS total
       FROM ks CROSS JOIN we LEFT JOIN mt ON mt.series = ks.series AND mt.bucket = ks.bucket AND mt.minute >= we.window_end - INTERVAL 24 HOUR AND mt.minute < we.window_end
       GROUP BY 1, 2, 3""",
)
def k6(spark: SparkSession, d: str) -> DataFrame:
    ends = F.expr(
        "sequence(TIMESTAMP_NTZ'2024-01-02 00:00:00', TIMESTAMP_NTZ'2024-01-31 00:00:00', INTERVAL 6 HOURS)"
    )
    made = trailing.trailing_totals(
        _minute_totals(txn(spark, d)), ends, F.expr("INTERVAL 24 HOURS")
    )
    made = made.withColumn("total", F.round(F.col("total"), 4) + F.lit(0.0))
    return stamped(made.select("series", "bucket", "window_end", "n", "total"))


_W = "strftime(time_bucket(INTERVAL 5 MINUTE, {ts}), '%Y-%m-%d %H:%M:%S') AS window_start"


@query(
    "l1_request_rate",
    f"""SELECT {_W.format(ts="ts")}, method, route, CASE WHEN status >= 500 THEN '5xx' ELSE '2xx' END AS status_class, round(count(*)/CAST(300 AS DOUBLE), 6) AS rate
       FROM log GROUP BY ALL""",
)
def l1(spark: SparkSession, d: str) -> DataFrame:
    """L1, L8."""
    return rounded(stamped(series.request_rate(canonical.request_log(txn(spark, d)))))


@query(
    "l2_error_rate",
    f"""SELECT {_W.format(ts="ts")}, round((count(*) FILTER (WHERE status >= 500)/CAST(300 AS DOUBLE))/greatest(count(*)/CAST(300 AS DOUBLE), 1e-6), 6) AS error_rate
       FROM log GROUP BY ALL""",
)
def l2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stamped(series.error_rate(canonical.request_log(txn(spark, d)))))


_B = series.LATENCY_BOUNDS


def _quantile_sql(q: float) -> str:
    cases = []
    for i, b in enumerate(_B):
        low = _B[i - 1] if i else 0.0
        prev = f"le{i - 1}" if i else "0"
        cases.append(
            f"WHEN le{i} >= {q}*total THEN {low} + ({b}-{low})*({q}*total-{prev})/CAST(nullif(le{i}-{prev}, 0) AS DOUBLE)"
        )
    return f"CASE {' '.join(cases)} ELSE {_B[-1]} END"


_LATENCY = (
    "+ lb AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, route, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE greatest(duration_seconds, 0) <= {b}) AS le{i}" for i, b in enumerate(_B))
    + " FROM log GROUP BY ALL)\n"
)


@query(
    "l3_latency_quantiles",
    _LATENCY
    + "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, route, "
    + ", ".join(f"round({_quantile_sql(q)}, 6) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
    + " FROM lb",
)
def l3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stamped(series.latency_quantiles(canonical.request_log(txn(spark, d)))))


@query(
    "l4_high_risk_rate",
    f"""SELECT {_W.format(ts="created_at")}, round(count(*) FILTER (WHERE risk_level='high')/CAST(300 AS DOUBLE), 6) AS rate FROM predictions GROUP BY ALL""",
)
def l4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stamped(series.high_risk_rate(canonical.predictions(txn(spark, d)))))


@query(
    "l5_rate_by_level",
    f"""SELECT {_W.format(ts="created_at")}, risk_level, round(count(*)/CAST(300 AS DOUBLE), 6) AS rate FROM predictions GROUP BY ALL""",
)
def l5(spark: SparkSession, d: str) -> DataFrame:
    made = series.prediction_rate(canonical.predictions(txn(spark, d)), "risk_level")
    return rounded(stamped(made))


@query(
    "l5_rate_by_type",
    f"""SELECT {_W.format(ts="created_at")}, transaction_type, round(count(*)/CAST(300 AS DOUBLE), 6) AS rate FROM predictions GROUP BY ALL""",
)
def l5_type(spark: SparkSession, d: str) -> DataFrame:
    made = series.prediction_rate(canonical.predictions(txn(spark, d)), "transaction_type")
    return rounded(stamped(made))


@query(
    "l6_score_buckets",
    " UNION ALL ".join(
        f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, created_at), '%Y-%m-%d %H:%M:%S') AS window_start, '{n}' AS le,
            CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS cumulative_count FROM predictions GROUP BY ALL"""
        for n, c in [*((str(b), f"fraud_score <= CAST({b} AS DOUBLE)") for b in series.SCORE_BOUNDS), ("+Inf", "TRUE")]
    ),
)
def l6(spark: SparkSession, d: str) -> DataFrame:
    made = series.score_buckets(canonical.predictions(txn(spark, d)), length="1 hour")
    return stamped(made)


@query(
    "l7_prediction_counters",
    """+ f AS (SELECT request_id, arg_min(amount, attempt) AS a0, min(attempt) AS t0 FROM attempts GROUP BY request_id),
       c AS (SELECT a.request_id, CASE WHEN a.amount <> f.a0 THEN 'conflict' WHEN a.attempt = f.t0 THEN 'new' ELSE 'replay' END AS status
             FROM attempts a JOIN f ON a.request_id = f.request_id),
       j AS (SELECT c.status, p.* FROM c JOIN predictions p ON c.request_id = p.prediction_id)
       SELECT 'predictions_total' AS counter, CAST(prediction AS VARCHAR) AS prediction, risk_level, transaction_type, '1' AS model_version, count(*) AS row_count
       FROM j WHERE status = 'new' GROUP BY ALL
       UNION ALL SELECT CASE status WHEN 'replay' THEN 'idempotent_replays_total' ELSE 'idempotency_conflicts_total' END, NULL, NULL, NULL, NULL, count(*)
       FROM j WHERE status <> 'new' GROUP BY ALL""",
)
def l7(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    classified = ledger.classify_attempts(canonical.intake_attempts(rows), payload="amount")
    preds = canonical.predictions(rows).select(
        F.col("prediction_id").alias("request_id"), "prediction", "risk_level", "transaction_type"
    )
    joined = classified.join(preds, "request_id").withColumn("model_version", F.lit("1"))
    return series.prediction_counters(joined)


@query(
    "l9_sustained_alerts",
    _LATENCY
    + f""", er AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, count(*) FILTER (WHERE status >= 500)/CAST(count(*) AS DOUBLE) AS v FROM log GROUP BY 1),
       pts AS (SELECT 'high_error_rate' AS alert, w FROM er WHERE v > 0.05
               UNION ALL SELECT 'high_p95_latency', w FROM (SELECT w, max({_quantile_sql(0.95)}) AS m FROM lb GROUP BY w) WHERE m > 1),
       isl AS (SELECT alert, w, w - to_minutes(CAST(5*row_number() OVER (PARTITION BY alert ORDER BY w) AS INTEGER)) AS g FROM pts),
       grp AS (SELECT alert, min(w) AS lo, max(w) AS hi, count(*) AS points FROM isl GROUP BY alert, g HAVING count(*) >= 2)
       SELECT alert, strftime(lo, '%Y-%m-%d %H:%M:%S') AS pending_since, strftime(hi, '%Y-%m-%d %H:%M:%S') AS last_true, points,
              strftime(lo + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS firing_since FROM grp""",
)
def l9(spark: SparkSession, d: str) -> DataFrame:
    return stamped(series.operational_alerts(canonical.request_log(txn(spark, d))))


_RULES = "(VALUES ('not_ready', 'ready', 0, 60), ('target_down', 'up', 0, 60), ('significant_drift', 'drift_severity', 2, 300)) AS r(alert, gauge, bad, hold)"


@query(
    "l9_gauge_alerts",
    f"""+ g AS (SELECT ts, 'ready' AS gauge, 'api' AS instance, CASE WHEN txn_id%4=0 THEN 0 ELSE 1 END AS value FROM txn
         UNION ALL SELECT ts, 'up', type, CASE WHEN txn_id%7<2 THEN 0 ELSE 1 END FROM txn
         UNION ALL SELECT ts, 'drift_severity', 'log_amount', CASE WHEN txn_id%5<3 THEN 2 ELSE txn_id%2 END FROM txn),
       m AS (SELECT alert, hold, instance, ts AS t, bool_and(value = bad) AS good FROM g JOIN {_RULES} ON g.gauge = r.gauge GROUP BY ALL),
       u AS (SELECT *, least(coalesce(lead(t) OVER w, t + INTERVAL 300 SECOND), t + INTERVAL 300 SECOND) AS til FROM m WINDOW w AS (PARTITION BY alert, instance ORDER BY t)),
       s AS (SELECT *, CASE WHEN good AND NOT coalesce(lag(good) OVER w AND lag(til) OVER w = t, FALSE) THEN 1 ELSE 0 END AS st FROM u WINDOW w AS (PARTITION BY alert, instance ORDER BY t)),
       k AS (SELECT *, sum(st) OVER (PARTITION BY alert, instance ORDER BY t) AS island FROM s)
       SELECT alert, instance, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS pending_since, strftime(min(t) + to_seconds(hold), '%Y-%m-%d %H:%M:%S') AS firing_since,
         strftime(max(til), '%Y-%m-%d %H:%M:%S') AS ended_at FROM k WHERE good GROUP BY alert, instance, hold, island HAVING max(til) - min(t) >= to_seconds(hold)""",
)
def l9_gauges(spark: SparkSession, d: str) -> DataFrame:
    return stamped(series.gauge_alerts(canonical.gauges(txn(spark, d))))


@query(
    "l10_stale_intervals",
    """+ o AS (SELECT route, ts, lag(ts) OVER (PARTITION BY route ORDER BY ts) AS prev FROM log WHERE status < 500),
       f AS (SELECT route, min(ts) AS seen, max(ts) FILTER (WHERE status < 500) AS lastok FROM log GROUP BY route),
       sp AS (SELECT o.route, prev AS ok, coalesce(prev, seen) AS since, ts AS until FROM o JOIN f ON o.route = f.route
              UNION ALL SELECT route, lastok, coalesce(lastok, seen), NULL FROM f)
       SELECT route, strftime(ok, '%Y-%m-%d %H:%M:%S') AS last_success, strftime(since + INTERVAL 420 SECOND, '%Y-%m-%d %H:%M:%S') AS firing_since,
              strftime(until, '%Y-%m-%d %H:%M:%S') AS resolved_at FROM sp WHERE coalesce(until, (SELECT max(ts) FROM log)) - since > INTERVAL 420 SECOND""",
)
def l10(spark: SparkSession, d: str) -> DataFrame:
    log = canonical.request_log(txn(spark, d))
    return stamped(series.stale_intervals(log, F.col("status") < 500, by=["route"]))


@query(
    "l11_request_fields",
    """SELECT request_id, count(*) AS batch_size, count(prediction) AS prediction_count, count(*) FILTER (WHERE risk_level='high') AS high_risk_prediction_count
       FROM predictions GROUP BY request_id""",
)
def l11(spark: SparkSession, d: str) -> DataFrame:
    return series.request_fields(canonical.predictions(txn(spark, d)))
