"""Registered queries for models, evaluation and audits (F-H)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.exprs import logistic_score, predict, risk_level
from tollgate.functions.features import FEATURES, add_features
from tollgate.operators import chrono, evaluate, models, shortcuts
from tollgate.plans.core_queries import FEATURES_CTE, periods_of, train_of
from tollgate.plans.registry import query, rounded, txn
from tollgate.schemas import OPERATIONAL_THRESHOLD
from tollgate.session import checkpointed, shared_folder
from tollgate.sources.versioned import VersionedTable


def scored(rows: DataFrame) -> DataFrame:
    """The deterministic fixture score in the shape the evaluation operators take."""
    return rows.select(
        F.col("txn_id").alias("id"),
        F.col("isFraud").alias("label"),
        "amount",
        F.col("fraud_score").alias("score"),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """Three candidates side by side: a constant prior and two fixture scores."""
    prior = models.prior_score(train_of(rows))
    s = F.col("score")
    scores = {
        "prior_probability": prior,
        "unweighted_logistic": s,
        "weighted_logistic": F.when(F.col("id") % 7 == 0, s * 0.5).otherwise(s),
    }
    per = F.array(
        *[F.struct(F.lit(n).alias("candidate"), c.alias("score")) for n, c in scores.items()]
    )
    return scored(rows).select("id", "label", "amount", F.inline(per))


def bundle(rows: DataFrame) -> DataFrame:
    return evaluate.evaluation_bundle(candidates(rows))


@query(
    "f1_scaler_statistics",
    FEATURES_CTE
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, round(avg({n}), 4) AS mean,
            round(CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END, 4) AS scale FROM feats WHERE split = 'train'"""
        for n in FEATURES
    ),
)
def f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.scaler_statistics(add_features(train_of(txn(spark, d)))), 4)


@query(
    "f2_standardised",
    FEATURES_CTE
    + """, s AS (SELECT avg(log_amount) AS m1, stddev_pop(log_amount) AS s1, avg(step) AS m2, stddev_pop(step) AS s2 FROM feats WHERE split = 'train')
       SELECT txn_id, round((log_amount-m1)/s1, 4) AS log_amount, round((step-m2)/s2, 4) AS step FROM feats, s WHERE split = 'train'""",
)
def f2(spark: SparkSession, d: str) -> DataFrame:
    rows = add_features(train_of(txn(spark, d)), keep=["txn_id"])
    names = ["log_amount", "step"]
    stats = models.statistics_of(rows, names)
    return rounded(rows.select("txn_id", *models.standardised(rows, names, stats)), 4)


@query("f3_logistic_candidates")
def f3(spark: SparkSession, d: str) -> DataFrame:
    """prior, unweighted, balanced and positive-weighted models on validation."""
    from tollgate.operators.sampling import positive_weight, with_balanced_weight

    rows = txn(spark, d)
    bounds = chrono.choose_boundaries(rows)
    split = bounds.split(F.col("step"))
    train, validation = rows.where(split == "train"), rows.where(split == "validation")
    prepared = models.fit_rows(with_balanced_weight(train), ["weight"])
    fitted = {
        "prior_probability": models.prior_score(prepared.rows),
        "unweighted_logistic": models.fit_logistic(prepared).score(),
        "weighted_logistic": models.fit_logistic(prepared, F.col("weight")).score(),
        "positive_weight_5": models.fit_logistic(prepared, positive_weight(5.0), 1e-5).score(),
    }
    return rounded(
        evaluate.evaluation_bundle(
            checkpointed(models.score_candidates(validation, fitted))
        ).select(
            "candidate", "row_count", "fraud_count", "average_precision", "roc_auc",
            "selected_threshold", "selected_f_beta", "selected_alert_rate",
        )
    )


@query("f6_boosted_trees")
def f6(spark: SparkSession, d: str) -> DataFrame:
    fit, tuning = _inner(spark, d)
    sample = models.weighted_sample(fit, 500_000)
    model = models.fit_trees(
        sample, {"max_depth": 3, "learning_rate": 0.1}, 20, validation=tuning
    )
    made = evaluate.evaluation_bundle(
        checkpointed(models.score_model(model, tuning, "boosted_trees"))
    )
    return rounded(made.select("candidate", "row_count", "fraud_count", "average_precision", "roc_auc"))


@query("f7_shallow_tree")
def f7(spark: SparkSession, d: str) -> DataFrame:
    """The fit is bounded to 25 000 negatives; all tuning rows are evaluated."""
    fit, tuning = _inner(spark, d)
    tree = models.fit_shallow_tree(models.weighted_sample(fit, 25_000))
    made = evaluate.evaluation_bundle(
        checkpointed(models.score_model(tree, tuning, "shallow_tree"))
    )
    return rounded(
        made.select(
            "candidate",
            "average_precision",
            "roc_auc",
            F.lit(", ".join(models.used_features(tree))).alias("features_used"),
            F.lit(models.tree_rules(tree)).alias("tree_rules"),
        )
    )


# An example frozen model over four features.
FROZEN = {
    "log_amount": (4.0, 1.5, 0.8),
    "log_oldbalance_origin": (5.0, 2.0, -0.6),
    "amount_exceeds_origin_balance": (0.25, 0.5, 1.2),
    "type_TRANSFER": (0.125, 0.25, 0.9),
}
FROZEN_INTERCEPT = -2.0


@query(
    "f8_frozen_scores",
    FEATURES_CTE
    + "SELECT txn_id, round(1/(1+exp(-("
    + str(FROZEN_INTERCEPT)
    + "".join(f" + {w}*(({n}-{m})/{s})" for n, (m, s, w) in FROZEN.items())
    + "))), 5) AS score FROM feats",
)
def f8(spark: SparkSession, d: str) -> DataFrame:
    means, scales, weights = zip(*FROZEN.values())
    score = logistic_score(list(FROZEN), means, scales, weights, FROZEN_INTERCEPT)
    rows = add_features(txn(spark, d), keep=["txn_id"])
    return rounded(rows.select("txn_id", score.alias("score")), 5)


@query(
    "f9_decisions",
    """SELECT prediction, risk_level, CAST(0.98310834 AS DOUBLE) AS threshold, count(*) AS row_count, round(min(fraud_score), 6) AS lowest,
       round(max(fraud_score), 6) AS highest FROM predictions GROUP BY 1, 2""",
)
def f9(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("fraud_score")
    return rounded(
        txn(spark, d)
        .groupBy(
            predict(score).alias("prediction"),
            risk_level(score).alias("risk_level"),
        )
        .agg(
            F.lit(OPERATIONAL_THRESHOLD).alias("threshold"),
            F.count(F.lit(1)).alias("row_count"),
            F.min(score).alias("lowest"),
            F.max(score).alias("highest"),
        ),
        6,
        threshold=8,
    )


@query(
    "f10_candidate_scores",
    "SELECT candidate, id, label, round(score, 6) AS score FROM candidates",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(candidates(txn(spark, d)).select("candidate", "id", "label", "score"))


def _inner(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = txn(spark, d)
    found = chrono.audit_periods(rows)
    return tuple(rows.where(found[w].contains(F.col("step"))) for w in ("inner_fit", "inner_tuning"))


@query("f11_logistic_search")
def f11(spark: SparkSession, d: str) -> DataFrame:
    fit, tuning = _inner(spark, d)
    made, _ = models.logistic_search(fit, tuning, models.logistic_trials())
    return rounded(
        made.select(
            F.col("candidate").alias("trial_id"), "average_precision", "roc_auc", "selected_f_beta",
            "selected_alert_rate", F.col("cost_1").alias("positive_class_weight"),
            F.col("cost_2").alias("epochs"),
        )
    )


@query("f12_tree_search")
def f12(spark: SparkSession, d: str) -> DataFrame:
    """The first two of eight trials with 10 of their 200 to 700 rounds; README gives the time of all."""
    fit, tuning = _inner(spark, d)
    made, _ = models.tree_search(fit, tuning, models.tree_trials(limit=2), max_rounds=10)
    return rounded(
        made.select(
            F.col("candidate").alias("trial_id"), "average_precision", "roc_auc", "selected_f_beta",
            F.col("cost_1").alias("trees"), F.col("cost_2").alias("max_depth"),
        )
    )


@query(
    "f13_trial_ranking",
    """SELECT candidate AS best_trial FROM cfull
       ORDER BY round(average_precision, 9) DESC, round(selected_f_beta, 9) DESC, selected_alert_rate, length(candidate), candidate LIMIT 1""",
)
def f13(spark: SparkSession, d: str) -> DataFrame:
    costed = bundle(txn(spark, d)).withColumns(
        {"cost_1": F.length("candidate").cast("double"), "cost_2": F.lit(0.0)}
    )
    return models.rank_trials(costed)


@query(
    "f14_baseline_champion",
    """+ e AS (SELECT * FROM cfull WHERE candidate <> 'prior_probability' OR average_precision >=
          (SELECT max(average_precision) FROM cfull WHERE candidate <> 'prior_probability'))
       SELECT (SELECT candidate FROM e ORDER BY average_precision DESC, selected_f_beta DESC, selected_alert_rate, candidate='unweighted_logistic' DESC LIMIT 1) AS champion,
              (SELECT bool_or(candidate = 'prior_probability') FROM e) AS prior_eligible""",
)
def f14(spark: SparkSession, d: str) -> DataFrame:
    return models.baseline_champion(bundle(txn(spark, d)))


@query(
    "f15_challenger_champion",
    """+ b AS (SELECT * FROM cfull WHERE candidate <> 'prior_probability'
          ORDER BY average_precision DESC, selected_f_beta DESC, top_0_5_fraud_amount_recall DESC, selected_alert_rate, candidate='weighted_logistic' DESC LIMIT 1),
       i AS (SELECT b.candidate, b.average_precision - p.average_precision AS improvement FROM b, cfull p WHERE p.candidate = 'prior_probability')
       SELECT CASE WHEN improvement >= 0.001 THEN candidate ELSE 'prior_probability' END AS champion, round(improvement, 6) AS improvement FROM i""",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        models.challenger_champion(
            bundle(txn(spark, d)), baseline="prior_probability", simplest="weighted_logistic"
        )
    )


@query("f16_ablation")
def f16(spark: SparkSession, d: str) -> DataFrame:
    fit, tuning = _inner(spark, d)
    return rounded(models.ablation(fit, tuning, {"max_depth": 3, "learning_rate": 0.1}, 5))


@query("f17_permutation_test")
def f17(spark: SparkSession, d: str) -> DataFrame:
    fit, tuning = _inner(spark, d)
    return rounded(models.permutation_test(fit, tuning))


_COMPARED = """+ side AS (SELECT split AS side, txn_id AS id, isFraud AS label, amount, fraud_score AS score FROM splits WHERE split <> 'train'),
  sc AS (SELECT side, score, n, pos, sum(n) OVER w AS n_upto, sum(pos) OVER w AS pos_upto, sum(n) OVER (PARTITION BY side) AS n_total,
           sum(pos) OVER (PARTITION BY side) AS pos_total FROM (SELECT side, score, count(*) AS n, sum(label) AS pos FROM side GROUP BY 1, 2)
         WINDOW w AS (PARTITION BY side ORDER BY score DESC)),
  rk AS (SELECT side, sum((pos/CAST(pos_total AS DOUBLE))*(pos_upto/CAST(n_upto AS DOUBLE))) AS ap,
           sum((n-pos)*((pos_upto-pos)+pos/CAST(2 AS DOUBLE)))/(max(pos_total)*CAST(max(n_total-pos_total) AS DOUBLE)) AS auc FROM sc GROUP BY side),
  th AS (SELECT side, count(*) AS n, CAST(count(*) FILTER (WHERE label=1) AS DOUBLE) AS p,
           CAST(count(*) FILTER (WHERE label=1 AND score>=CAST({t} AS DOUBLE)) AS DOUBLE) AS tp,
           CAST(count(*) FILTER (WHERE label=0 AND score>=CAST({t} AS DOUBLE)) AS DOUBLE) AS fp,
           sum(CASE WHEN label=1 AND score>=CAST({t} AS DOUBLE) THEN amount ELSE 0 END)/sum(CASE WHEN label=1 THEN amount ELSE 0 END) AS ar FROM side GROUP BY side),
  v AS (SELECT th.*, rk.ap, rk.auc, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS pre, CASE WHEN p>0 THEN tp/p ELSE 0 END AS rec FROM th JOIN rk ON th.side = rk.side),
  lng AS (
    SELECT side, 'fraud_prevalence' AS metric, p/n AS value FROM v UNION ALL SELECT side, 'average_precision', ap FROM v
    UNION ALL SELECT side, 'roc_auc', auc FROM v UNION ALL SELECT side, 'precision', pre FROM v UNION ALL SELECT side, 'recall', rec FROM v
    UNION ALL SELECT side, 'f1', CASE WHEN pre+rec>0 THEN 2*pre*rec/(pre+rec) ELSE 0 END FROM v
    UNION ALL SELECT side, 'f2', CASE WHEN 4*pre+rec>0 THEN 5*pre*rec/(4*pre+rec) ELSE 0 END FROM v
    UNION ALL SELECT side, 'alert_rate', (tp+fp)/n FROM v UNION ALL SELECT side, 'false_positive_rate', fp/(n-p) FROM v
    UNION ALL SELECT side, 'fraud_amount_recall', ar FROM v)
""".replace("{t}", "0.75")


def _two_sides(rows: DataFrame) -> DataFrame:
    bounds = chrono.choose_boundaries(rows)
    late = rows.where(F.col("step") > bounds.train)
    return late.select(
        bounds.split(F.col("step")).alias("side"),
        F.col("txn_id").alias("id"),
        F.col("isFraud").alias("label"),
        "amount",
        F.col("fraud_score").alias("score"),
    )


@query(
    "f3_fit_certificates",
    """SELECT c.candidate, count(*) AS row_count, count(*) FILTER (WHERE isFraud = 1) AS fraud_count, TRUE AS certified, FALSE AS disturbed_certified
       FROM splits, (VALUES ('unweighted_logistic'), ('weighted_logistic'), ('positive_weight_5')) AS c(candidate) WHERE split = 'train' GROUP BY c.candidate""",
)
def f3_certificates(spark: SparkSession, d: str) -> DataFrame:
    """the gradient at each fit, and at the same fit with one coefficient moved by 0.5."""
    from dataclasses import replace

    from tollgate.operators.sampling import positive_weight, with_balanced_weight

    train = models.fit_rows(with_balanced_weight(train_of(txn(spark, d))), ["weight"])
    made = None
    for name, weight, alpha in (("unweighted_logistic", None, 1e-4), ("weighted_logistic", F.col("weight"), 1e-4), ("positive_weight_5", positive_weight(5.0), 1e-5)):
        model = models.fit_logistic(train, weight, alpha, 5)
        moved = replace(model, weights=[model.weights[0] + 0.5, *model.weights[1:]])
        rows = models.optimality(model, train, weight, alpha)
        other = models.optimality(moved, train, weight, alpha).select(F.col("residual").alias("other"))
        limit = models.RESIDUAL_SHARE * F.col("start")
        part = rows.crossJoin(other).select(F.lit(name).alias("candidate"), "row_count", "fraud_count", (F.col("residual") <= limit).alias("certified"), (F.col("other") <= limit).alias("disturbed_certified"))
        made = part if made is None else made.unionByName(part)
    return made


def _promoted(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A recorded production model, stored and read back, and the scores of its refit."""
    bounds = chrono.choose_boundaries(rows)
    split = bounds.split(F.col("step"))
    train, validation = rows.where(split == "train"), rows.where(split == "validation")

    def fitted() -> tuple[models.LinearModel, DataFrame]:
        model = models.fit_logistic(train, models.positive_weight(5.0), 1e-5)
        return model, checkpointed(models.score_candidates(validation, {"production": model.score()}))

    model, scored = fitted()
    record = models.recorded_model(model, scored, PROMOTION_THRESHOLD)
    table = VersionedTable(spark, f"{shared_folder(spark)}/model-{uuid.uuid4().hex}", record.schema)
    table.replace(record)
    return table.rows(), fitted()[1]


# The threshold at which the example's records are held against each other.
PROMOTION_THRESHOLD = 0.2


@query(
    "f18_promotion_check",
    """SELECT r.record, count(*) AS row_count, count(*) FILTER (WHERE isFraud = 1) AS fraud_count, r.metrics, r.promoted
       FROM splits, (VALUES ('recorded', 14, TRUE), ('altered', 14, FALSE)) AS r(record, metrics, promoted) WHERE split = 'validation' GROUP BY r.record, r.metrics, r.promoted""",
)
def f18(spark: SparkSession, d: str) -> DataFrame:
    """A refit against its record; and against a record of which one coefficient was altered."""
    rows = txn(spark, d)
    record, refit = _promoted(spark, rows)
    altered = models.model_of(record)
    altered.weights[altered.features.index("log_amount")] += 0.5
    split = chrono.choose_boundaries(rows).split(F.col("step"))
    other = checkpointed(models.score_candidates(rows.where(split == "validation"), {"production": altered.score()}))
    made = None
    for name, scored in (("recorded", refit), ("altered", other)):
        report = models.promotion_check(record, scored, PROMOTION_THRESHOLD)
        count = lambda *names: F.sum(F.when(F.col("metric").isin(*names) & (F.col("section") == "matrix"), F.col("actual"))).cast("bigint")
        part = report.agg(
            count("true_positive", "false_positive", "false_negative", "true_negative").alias("row_count"),
            count("true_positive", "false_negative").alias("fraud_count"),
            F.count("metric").cast("int").alias("metrics"),
            F.bool_and("matches").alias("promoted"),
        ).withColumn("record", F.lit(name))
        made = part if made is None else made.unionByName(part)
    return made.select("record", "row_count", "fraud_count", "metrics", "promoted")


_RATIOS = """round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END, 6) AS "precision", round(tp/p, 6) AS recall,
  round(CASE WHEN tp>0 THEN 2*(tp/(tp+fp))*(tp/p)/((tp/(tp+fp))+(tp/p)) ELSE 0 END, 6) AS f1,
  round(CASE WHEN tp>0 THEN {num}*(tp/(tp+fp))*(tp/p)/({b2}*(tp/(tp+fp))+(tp/p)) ELSE 0 END, 6) AS f_beta,
  round((n-p-fp)/(n-p), 6) AS specificity, round(fp/(n-p), 6) AS false_positive_rate, CAST(tp+fp AS BIGINT) AS predicted_positive_count,
  round((tp+fp)/n, 6) AS alert_rate, round(captured, 2) AS fraud_amount_captured, round(captured/money, 6) AS fraud_amount_recall,
  CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive, CAST(p-tp AS BIGINT) AS false_negative, CAST(n-p-fp AS BIGINT) AS true_negative"""


@query(
    "g1_threshold_metrics",
    """+ t AS (SELECT CAST(0.5 AS DOUBLE) AS threshold UNION ALL SELECT CAST(0.98310834 AS DOUBLE)),
       v AS (SELECT threshold, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS p,
             CAST(count(*) FILTER (WHERE label=1 AND score>=threshold) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label=0 AND score>=threshold) AS DOUBLE) AS fp,
             sum(CASE WHEN label=1 AND score>=threshold THEN amount ELSE 0 END) AS captured, sum(CASE WHEN label=1 THEN amount ELSE 0 END) AS money
             FROM scored, t GROUP BY threshold)
       SELECT threshold, """
    + _RATIOS.format(num=5, b2=4)
    + " FROM v",
)
def g1(spark: SparkSession, d: str) -> DataFrame:
    """G1, G2, G3."""
    made = evaluate.threshold_metrics(scored(txn(spark, d)), [0.5, OPERATIONAL_THRESHOLD])
    return rounded(made, 6, threshold=8, fraud_amount_captured=2)


@query(
    "g4_precision_recall_curve",
    """SELECT round(score, 9) AS threshold, round(p, 6) AS "precision", round(q, 6) AS recall FROM pr
       UNION ALL SELECT NULL, 1.0, 0.0""",
)
def g4(spark: SparkSession, d: str) -> DataFrame:
    curve = evaluate.score_curve(scored(txn(spark, d)))
    return rounded(evaluate.precision_recall_curve(curve), 6, threshold=9)


@query(
    "g5_average_precision",
    """SELECT round(sum((pos/CAST(pos_total AS DOUBLE))*p), 6) AS average_precision,
       round(sum((n-pos)*((pos_upto-pos)+pos/CAST(2 AS DOUBLE)))/(max(pos_total)*CAST(max(n_total-pos_total) AS DOUBLE)), 6) AS roc_auc FROM pr""",
)
def g5(spark: SparkSession, d: str) -> DataFrame:
    """G5, G7."""
    return rounded(evaluate.ranking_metrics(evaluate.score_curve(scored(txn(spark, d)))))


@query(
    "g6_roc_curve",
    "SELECT round(score, 9) AS threshold, round((n_upto-pos_upto)/CAST(n_total-pos_total AS DOUBLE), 6) AS fpr, round(q, 6) AS tpr FROM pr",
)
def g6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.roc_curve(evaluate.score_curve(scored(txn(spark, d)))), 6, threshold=9)


@query(
    "g8_best_thresholds",
    """+ a AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN p+q>0 THEN 2*p*q/(p+q) ELSE 0 END DESC, score) AS r1,
             row_number() OVER (ORDER BY CASE WHEN 4*p+q>0 THEN 5*p*q/(4*p+q) ELSE 0 END DESC, score) AS r2 FROM pr),
       v AS (SELECT 'best_f1' AS objective, score, pos_upto, n_upto, pos_total, n_total, money_upto, money_total FROM a WHERE r1=1
             UNION ALL SELECT 'best_f2', score, pos_upto, n_upto, pos_total, n_total, money_upto, money_total FROM a WHERE r2=1),
       w AS (SELECT objective, score, CAST(pos_upto AS DOUBLE) AS tp, CAST(n_upto-pos_upto AS DOUBLE) AS fp, CAST(pos_total AS DOUBLE) AS p,
             CAST(n_total AS DOUBLE) AS n, money_upto AS captured, money_total AS money FROM v)
       SELECT objective, round(score, 9) AS threshold, """
    + _RATIOS.format(
        num="(CASE WHEN objective='best_f1' THEN 2 ELSE 5 END)",
        b2="(CASE WHEN objective='best_f1' THEN 1 ELSE 4 END)",
    )
    + " FROM w",
)
def g8(spark: SparkSession, d: str) -> DataFrame:
    made = evaluate.best_thresholds(evaluate.score_curve(scored(txn(spark, d))))
    return rounded(made, 6, threshold=9, fraud_amount_captured=2)


@query(
    "g9_topk_review",
    """+ k AS (SELECT unnest([CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(1.0 AS DOUBLE)]) AS pct),
       o AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn, count(*) OVER () AS n, sum(label) OVER () AS p, sum(label*amount) OVER () AS money FROM scored),
       v AS (SELECT pct, CAST(least(n, greatest(1, ceil(n*pct/100))) AS BIGINT) AS reviewed, o.* FROM o, k)
       SELECT pct AS top_k_percentage, max(reviewed) AS reviewed_transactions, CAST(sum(label) AS BIGINT) AS frauds_captured,
         round(sum(label)/CAST(max(p) AS DOUBLE), 6) AS recall, round(sum(label)/CAST(max(reviewed) AS DOUBLE), 6) AS "precision",
         round(sum(label*amount), 2) AS fraud_amount_captured, round(sum(label*amount)/max(money), 6) AS fraud_amount_recall
       FROM v WHERE rn <= reviewed GROUP BY pct""",
)
def g9(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(txn(spark, d))
    made = evaluate.top_k(rows, evaluate.score_curve(rows))
    return rounded(made, 6, fraud_amount_captured=2)


_POINTS = {
    "q_0": 0, "q_0_001": 0.001, "q_0_01": 0.01, "q_0_05": 0.05, "q_0_5": 0.5, "q_0_95": 0.95, "q_0_99": 0.99,
    "q_0_999": 0.999, "q_1": 1, "median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999,
}


@query(
    "g10_score_summary",
    "SELECT round(min(score), 6) AS minimum, round(max(score), 6) AS maximum, round(avg(score), 6) AS mean, "
    + ", ".join(f"round(quantile_cont(score, CAST({q} AS DOUBLE)), 6) AS {n}" for n, q in _POINTS.items())
    + """, count(*) FILTER (WHERE score=0) AS exact_zero_count, count(*) FILTER (WHERE score=1) AS exact_one_count
       FROM (SELECT least(greatest(score, 0), 1) AS score FROM scored)""",
)
def g10(spark: SparkSession, d: str) -> DataFrame:
    """G10, G11."""
    return rounded(evaluate.score_summary(evaluate.score_curve(scored(txn(spark, d)))))


@query(
    "g12_score_histogram",
    """+ s AS (SELECT min(score) AS lo, max(score) AS hi FROM scored)
       SELECT CAST(least(floor((score-lo)/((hi-lo)/CAST(80 AS DOUBLE))), 79) AS INT) AS bin, count(*) AS row_count FROM scored, s GROUP BY 1""",
)
def g12(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.score_histogram(scored(txn(spark, d)))


@query(
    "g13_threshold_table",
    'SELECT round(score, 9) AS threshold, round(p, 6) AS "precision", round(q, 6) AS recall FROM pr',
)
def g13(spark: SparkSession, d: str) -> DataFrame:
    curve = evaluate.score_curve(scored(txn(spark, d)))
    return rounded(evaluate.threshold_table(curve), 6, threshold=9)


@query(
    "g14_period_comparison",
    _COMPARED
    + """SELECT a.metric, round(a.value, 6) AS before_value, round(b.value, 6) AS after_value, round(b.value-a.value, 6) AS absolute_change,
         round(CASE WHEN a.value<>0 THEN (b.value-a.value)/abs(a.value) END, 6) AS relative_change, b.value-a.value > 0 AS improved
       FROM lng a JOIN lng b ON a.metric = b.metric WHERE a.side = 'validation' AND b.side = 'test'""",
)
def g14(spark: SparkSession, d: str) -> DataFrame:
    long = evaluate.compared_metrics(_two_sides(txn(spark, d)), 0.75, "side")
    before, after = long.where("side = 'validation'"), long.where("side = 'test'")
    return rounded(evaluate.compare_periods(before, after))


@query(
    "g14_topk_comparison",
    _COMPARED
    + """, k AS (SELECT unnest([CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(1.0 AS DOUBLE)]) AS pct),
       o AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY score DESC, id) AS rn, count(*) OVER t AS n, sum(label) OVER t AS p,
             sum(label*amount) OVER t AS money FROM side WINDOW t AS (PARTITION BY side)),
       tk AS (SELECT side, pct, sum(CASE WHEN rn <= greatest(1, ceil(n*pct/100)) THEN label ELSE 0 END)/CAST(max(p) AS DOUBLE) AS rec,
             sum(CASE WHEN rn <= greatest(1, ceil(n*pct/100)) THEN label*amount ELSE 0 END)/max(money) AS ar FROM o, k GROUP BY side, pct)
       SELECT a.pct AS top_k_percentage, round(a.rec, 6) AS before_recall, round(b.rec, 6) AS after_recall, round(b.rec-a.rec, 6) AS recall_absolute_change,
         round(a.ar, 6) AS before_fraud_amount_recall, round(b.ar, 6) AS after_fraud_amount_recall, round(b.ar-a.ar, 6) AS fraud_amount_recall_absolute_change
       FROM tk a JOIN tk b ON a.pct = b.pct WHERE a.side = 'validation' AND b.side = 'test'""",
)
def g14_top(spark: SparkSession, d: str) -> DataFrame:
    rows = _two_sides(txn(spark, d))
    tops = evaluate.top_k(rows, evaluate.score_curve(rows, by=["side"]), by=["side"])
    return rounded(
        evaluate.compare_top_k(tops.where("side = 'validation'"), tops.where("side = 'test'"))
    )


@query(
    "g15_metric_equality",
    _COMPARED.replace("0.75", "0.5")
    + """, al AS (SELECT metric, value FROM lng WHERE side = 'test'
         UNION ALL SELECT 'true_positive', tp FROM th WHERE side = 'test' UNION ALL SELECT 'false_positive', fp FROM th WHERE side = 'test'
         UNION ALL SELECT 'false_negative', p-tp FROM th WHERE side = 'test' UNION ALL SELECT 'true_negative', n-p-fp FROM th WHERE side = 'test')
       SELECT metric, round(value, 6) AS value, TRUE AS matches, FALSE AS altered_matches FROM al
       UNION ALL SELECT 'unknown_metric', NULL, FALSE, FALSE""",
)
def g15(spark: SparkSession, d: str) -> DataFrame:
    """Metrics and matrix straight from the rows, and from the bundle's curve, must agree; altered
    ones, and a metric known to one side, must not."""
    side = _two_sides(txn(spark, d)).where(F.col("side") == "test")
    one = models.recorded_metrics(side, 0.5).select(F.col("name").alias("metric"), "value")
    wide = evaluate.evaluation_bundle(side.withColumnRenamed("side", "candidate"))
    same = {n: f"at_0_5_{n}" for n in ("precision", "recall", "f1", "alert_rate", "false_positive_rate", "fraud_amount_recall", "true_positive", "false_positive", "false_negative", "true_negative")}
    same |= {"f2": "at_0_5_f_beta", "average_precision": "average_precision", "roc_auc": "roc_auc"}
    two = wide.select(*[F.col(c).cast("double").alias(n) for n, c in same.items()], (F.col("fraud_count") / F.col("row_count")).alias("fraud_prevalence"), F.lit(1.0).alias("unknown_metric"))
    two = two.unpivot([], two.columns, "metric", "value")
    altered = two.withColumn("value", F.col("value") * 1.001 + 0.001)
    made = evaluate.metrics_match(one, two, rtol=1e-9).select("metric", F.col("actual").alias("value"), "matches")
    other = evaluate.metrics_match(one, altered, rtol=1e-9).select("metric", F.col("matches").alias("altered_matches"))
    return rounded(made.join(other, "metric"))


@query(
    "g16_evaluation_bundle",
    """SELECT candidate, CAST(n_total AS BIGINT) AS row_count, CAST(pos_total AS BIGINT) AS fraud_count, round(average_precision, 6) AS average_precision,
       round(roc_auc, 6) AS roc_auc, round(selected_threshold, 9) AS selected_threshold, CAST(tp AS BIGINT) AS selected_true_positive,
       CAST(fp AS BIGINT) AS selected_false_positive, round(selected_f_beta, 6) AS selected_f_beta, round(selected_alert_rate, 6) AS selected_alert_rate,
       round(top_0_5_recall, 6) AS top_0_5_recall, round(top_0_5_fraud_amount_recall, 6) AS top_0_5_fraud_amount_recall,
       lo AS score_minimum, hi AS score_maximum, av AS score_mean, md AS score_median, p99 AS score_p99, zeros AS score_exact_zero_count
       FROM cfull JOIN (SELECT candidate, round(min(s), 6) AS lo, round(max(s), 6) AS hi, round(avg(s), 6) AS av, round(quantile_cont(s, CAST(0.5 AS DOUBLE)), 6) AS md,
           round(quantile_cont(s, CAST(0.99 AS DOUBLE)), 6) AS p99, count(*) FILTER (WHERE s = 0) AS zeros
         FROM (SELECT candidate, least(greatest(score, 0), 1) AS s FROM candidates) GROUP BY candidate) USING (candidate)""",
)
def g16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        bundle(txn(spark, d)).select(
            "candidate", "row_count", "fraud_count", "average_precision", "roc_auc",
            "selected_threshold", "selected_true_positive", "selected_false_positive",
            "selected_f_beta", "selected_alert_rate", "top_0_5_recall", "top_0_5_fraud_amount_recall",
            "score_minimum", "score_maximum", "score_mean", "score_median", "score_p99", "score_exact_zero_count",
        ),
        6,
        selected_threshold=9,
    )


_FLAT = {
    "pr_auc": "average_precision", "roc_auc": "roc_auc", "precision": "selected_precision", "recall": "selected_recall",
    "f1": "selected_f1", "f2": "selected_f_beta", "alert_rate": "selected_alert_rate",
    "false_positive_rate": "selected_false_positive_rate", "fraud_amount_recall": "selected_fraud_amount_recall",
    **{f"top_{k}_percent_{m}": f"top_{k}_{m}" for k in ("0_1", "0_5", "1_0") for m in ("recall", "fraud_amount_recall")},
}


@query(
    "g17_flat_metrics",
    " UNION ALL ".join(
        f"SELECT candidate, 'validation_{k}' AS metric, round(CAST({v} AS DOUBLE), 6) AS value FROM cfull"
        for k, v in _FLAT.items()
    ),
)
def g17(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.flat_metrics(bundle(txn(spark, d)), "validation"))


def _duplicates_sql(columns: list[str], decimals: int | None) -> str:
    shown = ", ".join(
        f"CAST(round_even({c}*1000, 0)/1000 AS FLOAT) AS {c}" if decimals else c for c in columns
    )
    keys = ", ".join(columns)
    return (
        FEATURES_CTE
        + f""", f AS (SELECT split, isFraud AS label, {shown} FROM feats WHERE split <> 'test'),
       t AS (SELECT {keys}, count(*) AS n, bit_or(1 << label) AS mask FROM f WHERE split = 'train' GROUP BY ALL),
       v AS (SELECT f.label, t.mask FROM f LEFT JOIN t ON {" AND ".join(f"f.{c} = t.{c}" for c in columns)} WHERE f.split = 'validation'),
       c AS (SELECT count(*) AS vr, count(mask) AS m, count(*) FILTER (WHERE mask IN (1,2) AND mask = (1 << label)) AS same,
             count(*) FILTER (WHERE mask IN (1,2) AND mask <> (1 << label)) AS opp, count(*) FILTER (WHERE mask = 3) AS mixed FROM v)
       SELECT CAST({decimals or "NULL"} AS INT) AS rounding_decimals, (SELECT CAST(sum(n) AS BIGINT) FROM t) AS train_rows, vr AS validation_rows,
         (SELECT count(*) FROM t) AS unique_train_feature_patterns, m AS matching_validation_rows, same AS matching_same_label_rows,
         opp AS matching_opposite_label_rows, mixed AS matching_mixed_train_label_rows,
         round(CASE WHEN vr>0 THEN m/CAST(vr AS DOUBLE)*100 ELSE 0 END, 6) AS matching_validation_percentage,
         round(CASE WHEN m>0 THEN same/CAST(m AS DOUBLE)*100 ELSE 0 END, 6) AS same_label_among_matches_percentage FROM c"""
    )


# Columns under which the fixture does have repeats; the full set is the exact audit.
_COARSE = ["hour_of_day", "log_oldbalance_origin", "origin_balance_zero_before", "type_TRANSFER", "type_CASH_OUT"]


def _duplicates(spark: SparkSession, d: str, decimals: int | None, columns: list[str]) -> DataFrame:
    rows = txn(spark, d)
    split = chrono.choose_boundaries(rows).split(F.col("step"))
    return rounded(
        shortcuts.duplicate_patterns(
            rows, split == "train", split == "validation", decimals, columns
        )
    )


@query("h2_duplicates_exact", _duplicates_sql(FEATURES, None))
def h2_exact(spark: SparkSession, d: str) -> DataFrame:
    """H1, H2 over all 17 features."""
    return _duplicates(spark, d, None, FEATURES)


@query("h2_duplicates_coarse", _duplicates_sql(_COARSE, 3))
def h2_coarse(spark: SparkSession, d: str) -> DataFrame:
    """H1, H2 rounded half-even to 3 decimals, over columns that do repeat."""
    return _duplicates(spark, d, 3, _COARSE)


_EQ = "abs(oldbalanceOrg-amount) <= 1e-6 + 1e-9*abs(amount)"
_TC = "type IN ('TRANSFER','CASH_OUT')"
_D0 = "abs(oldbalanceDest) <= 1e-6"
_RULE_SQL = {
    "type_TRANSFER": "type='TRANSFER'",
    "type_CASH_OUT": "type='CASH_OUT'",
    "oldbalanceOrg_equals_amount": _EQ,
    "amount_ge_oldbalanceOrg": "amount >= oldbalanceOrg - 1e-6",
    "oldbalanceOrg_zero": "abs(oldbalanceOrg) <= 1e-6",
    "oldbalanceDest_zero": _D0,
    "amount_to_origin_balance_ge_0_99": "amount/(oldbalanceOrg+1) >= CAST(0.99 AS DOUBLE)",
    "transfer_or_cashout_and_amount_ge_oldbalanceOrg": f"{_TC} AND amount >= oldbalanceOrg - 1e-6",
    "transfer_or_cashout_and_oldbalanceOrg_equals_amount": f"{_TC} AND {_EQ}",
    "transfer_and_oldbalanceDest_zero": f"type='TRANSFER' AND {_D0}",
    "cashout_and_oldbalanceDest_zero": f"type='CASH_OUT' AND {_D0}",
    "transfer_or_cashout_origin_equals_amount_dest_zero": f"{_TC} AND {_EQ} AND {_D0}",
}
_RULES_CTE = (
    "+ rp AS ("
    + " UNION ALL ".join(
        f"SELECT period, '{n}' AS rule, count(*) FILTER (WHERE {p}) AS support, count(*) FILTER (WHERE {p} AND isFraud=1) AS fraud_count, "
        "sum(isFraud) AS frauds FROM periods GROUP BY period"
        for n, p in _RULE_SQL.items()
    )
    + """), rq AS (SELECT period, rule, support, fraud_count, support-fraud_count AS nonfraud_count,
         CASE WHEN support>0 THEN fraud_count/CAST(support AS DOUBLE) ELSE 0 END AS prec, CASE WHEN frauds>0 THEN fraud_count/CAST(frauds AS DOUBLE) ELSE 0 END AS rec FROM rp)
"""
)


@query(
    "h3_rules",
    "SELECT txn_id, "
    + ", ".join(f"{p} AS {n}" for n, p in _RULE_SQL.items())
    + " FROM txn",
)
def h3(spark: SparkSession, d: str) -> DataFrame:
    return txn(spark, d).select("txn_id", *[c.alias(n) for n, c in shortcuts.rules().items()])


@query(
    "h4_rule_performance",
    _RULES_CTE
    + 'SELECT period, rule, support, fraud_count, nonfraud_count, round(prec, 6) AS "precision", round(rec, 6) AS recall FROM rq',
)
def h4(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    return rounded(shortcuts.rule_performance(rows, periods_of(rows)))


@query(
    "h5_strongest_rule",
    _RULES_CTE
    + """SELECT rule, support, round(prec, 6) AS "precision", round(rec, 6) AS recall, prec > 0.5 AND rec > 0.9 AS shortcut_likely
       FROM rq WHERE period = 'official_validation' ORDER BY rec DESC, prec DESC, support DESC LIMIT 1""",
)
def h5(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    made = shortcuts.strongest_rule(shortcuts.rule_performance(rows, periods_of(rows)))
    return rounded(made.select("rule", "support", "precision", "recall", "shortcut_likely"))


@query("h6_verdict")
def h6(spark: SparkSession, d: str) -> DataFrame:
    rows = txn(spark, d)
    bounds = chrono.choose_boundaries(rows)
    split = bounds.split(F.col("step"))
    strongest = shortcuts.strongest_rule(shortcuts.rule_performance(rows, periods_of(rows)))
    duplicates = shortcuts.duplicate_patterns(rows, split == "train", split == "validation")
    fit, tuning = _inner(spark, d)
    permutation = models.permutation_test(fit, tuning)
    record, refit = _promoted(spark, rows)
    reproduced = evaluate.all_match(models.promotion_check(record, refit, PROMOTION_THRESHOLD))
    return shortcuts.verdict(strongest, duplicates, permutation, reproduced)
