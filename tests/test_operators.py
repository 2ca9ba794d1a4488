"""Hand-computed numbers, edge cases and invariants."""

import dataclasses
import math
import random
import struct
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tollgate.functions import features
from tollgate.functions.exprs import logistic_score, status_class
from tollgate.operators import (
    chrono,
    drift,
    evaluate,
    keyed,
    ledger,
    models,
    ordered,
    profile,
    quality,
    sampling,
    series,
    shortcuts,
)
from tollgate.schemas import (
    TRANSACTION_COLUMNS,
    ContractError,
    check_header,
    check_model_inputs,
    check_profile_columns,
    check_profile_split,
)
from tollgate.sources import canonical, tables
from tollgate.streaming.scoring import request_items, score_rows


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()


def scored(spark, labels, scores, amounts=None):
    amounts = amounts or [1.0] * len(labels)
    data = [(i, y, float(a), float(s)) for i, (y, s, a) in enumerate(zip(labels, scores, amounts))]
    return spark.createDataFrame(data, "id bigint, label int, amount double, score double")


def transactions(spark, data):
    return spark.createDataFrame(
        data,
        "txn_id bigint, step bigint, type string, amount double, oldbalanceOrg double, "
        "oldbalanceDest double, isFraud int",
    )


# Running totals and exact quantiles


@pytest.mark.parametrize("cuts", [[], [0.5], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], [-5.0, 99.0]])
def test_running_totals_do_not_depend_on_the_cuts(spark, cuts):
    df = spark.range(200).select((F.col("id") % 37 / 37).alias("k"), (F.col("id") % 5).alias("v"))
    got = ordered.running_totals(
        df, "k", {"n": F.count(F.lit(1)), "v": F.sum("v")}, descending=True, cuts=cuts
    )
    rows = {r["k"]: r for r in got.collect()}
    local = [(r["k"], r["v"]) for r in df.collect()]
    for k, r in rows.items():
        assert r["n_upto"] == sum(x >= k for x, _ in local)
        assert r["v_upto"] == sum(v for x, v in local if x >= k)
        assert r["n_total"] == 200


def test_running_totals_per_group_with_ties(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") % 3 * 10 + F.col("id") % 4).cast("double").alias("k")
    )
    got = ordered.running_totals(df, "k", {"n": F.count(F.lit(1))}, by=["g"])
    assert got.groupBy("g").agg((F.max("n_upto") == F.max("n_total")).alias("x")).where("x").count() == 3


def test_exact_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 10]], "v double")
    got = one(ordered.exact_quantiles(df, "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}))
    assert (got["a"], got["b"], got["d"]) == (1.0, 2.5, 10.0)
    assert got["c"] == pytest.approx(3 + 7 * 0.85)


@pytest.mark.parametrize("n", [1, 10, 499, 500, 501])
def test_smallest_is_exact(spark, n):
    df = sampling.keyed(spark.range(500), 7, "id")
    rows = sorted((r["_sample_key"], r["id"]) for r in df.collect())
    got = ordered.smallest(df, n, "_sample_key", "id").collect()
    assert sorted((r["_sample_key"], r["id"]) for r in got) == rows[:n]


def test_results_do_not_depend_on_partitions(spark, small_dir):
    rows = canonical.transactions(spark, small_dir)
    base = None
    for parts in (1, 7, 64):
        s = rows.repartition(parts).select(
            F.col("txn_id").alias("id"), F.col("isFraud").alias("label"), "amount",
            F.col("fraud_score").alias("score"), F.lit("m").alias("candidate"),
        )
        got = [
            round(v, 9) if isinstance(v, float) else v
            for v in evaluate.evaluation_bundle(s).first()
        ]
        base = base or got
        assert got == base


def test_attach_splits_hot_keys(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id"
    )
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = keyed.attach(rows, facts, "k", "n")
    assert got.count() == 20_000
    assert got.where("k = -1").select("first").distinct().collect()[0][0] == 0


# Contracts


def test_header_must_match_in_order():
    check_header(TRANSACTION_COLUMNS)
    with pytest.raises(ContractError, match="missing: none; unexpected: none"):
        check_header(list(reversed(TRANSACTION_COLUMNS)))
    with pytest.raises(ContractError, match=r"missing: \['amount'\]"):
        check_header([c for c in TRANSACTION_COLUMNS if c != "amount"])


def test_column_policy():
    check_model_inputs(["step", "type", "amount", "oldbalanceOrg", "oldbalanceDest"])
    for extra in ("isFraud", "nameOrig", "newbalanceDest", "other"):
        with pytest.raises(ContractError):
            check_model_inputs(["step", "type", "amount", "oldbalanceOrg", "oldbalanceDest", extra])
    with pytest.raises(ContractError):
        check_profile_columns(["amount", "amount"])
    with pytest.raises(ContractError):
        check_profile_columns(["isFraud"])
    with pytest.raises(ContractError):
        check_profile_split("test")


def test_csv_scan_split_sink_and_report(spark, small_dir):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    landed = canonical.landing(canonical.transactions(spark, small_dir)).drop("txn_id")
    landed.select(*TRANSACTION_COLUMNS).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    rows = tables.typed(tables.read_landing_csv(spark, f"{folder}/csv"))
    assert rows.columns == TRANSACTION_COLUMNS and rows.count() == 1000
    with pytest.raises(ContractError):
        tables.read_landing_csv(spark, f"{small_dir}/../sf0.001/documents.parquet")
    bounds = chrono.choose_boundaries(rows)
    tables.write_splits(rows, bounds.split(F.col("step")), f"{folder}/splits")
    sizes = [tables.read_split(spark, f"{folder}/splits", s).count() for s in ("train", "validation", "test")]
    assert sizes == [700, 152, 148]
    report = quality.quality_report(landed)
    tables.write_report(report, f"{folder}/report", "json")
    nested = tables.nested_report(report)
    assert one(nested.where("section = 'summary'"))["metrics"]["total_rows"] == 1000


def test_quality_passes_clean_rows(spark):
    clean = [("1", "PAYMENT", "10.0", "C1", "1", "1", "M1", "0", "0", "0", "0")] * 2
    names = ", ".join(f"{c} string" for c in TRANSACTION_COLUMNS)
    report = quality.quality_report(spark.createDataFrame(clean, names))
    values = {r["metric"]: r["value"] for r in report.where("section = 'summary'").collect()}
    assert values["passed"] == 1.0 and values["fraud_percentage"] == 0.0
    empty = quality.quality_report(spark.createDataFrame([], names))
    values = {r["metric"]: r["value"] for r in empty.where("section = 'summary'").collect()}
    assert values["total_rows"] == 0 and values["fraud_percentage"] == 0.0


def test_contract_reasons(spark):
    data = [("1", "TRANSFER", "5", "0", "0"), ("1.5", "TRANSFER", "5", "0", "0"),
            ("0", "WIRE", "NaN", "-1", None)]
    df = spark.createDataFrame(
        data, "step string, type string, amount string, oldbalanceOrg string, oldbalanceDest string"
    )
    reasons = [r["reject_reasons"] for r in quality.contract(df).collect()]
    assert reasons[0] == [] and reasons[1] == ["step_not_positive_integer"]
    assert reasons[2] == [
        "amount_not_finite", "oldbalanceDest_not_finite", "oldbalanceOrg_negative",
        "step_not_positive_integer", "type_unknown",
    ]


# Features


def test_features(spark):
    df = transactions(
        spark,
        [(1, 1, "CASH_IN", 10.0, 0.0, 5.0, 0), (2, 24, "PAYMENT", 20.0, 30.0, 0.0, 0),
         (3, 25, "TRANSFER", 30.0, 10.0, 0.0, 1)],
    )
    made = features.add_features(df)
    assert made.columns == features.FEATURES and len(made.columns) == 17
    assert {t for _, t in made.dtypes} == {"float"}
    got = [r.asDict() for r in made.collect()]
    assert [r["hour_of_day"] for r in got] == [0.0, 23.0, 0.0]
    assert got[1]["hour_sin"] == pytest.approx(math.sin(2 * math.pi * 23 / 24), abs=1e-6)
    assert got[2]["log_amount_to_origin_balance"] == pytest.approx(math.log1p(30 / 11), rel=1e-6)
    assert [r["amount_exceeds_origin_balance"] for r in got] == [1.0, 0.0, 1.0]
    assert [r["destination_balance_zero_before"] for r in got] == [0.0, 1.0, 1.0]
    assert features.not_finite_count(made).agg(F.sum("bad_rows")).first()[0] == 0


def test_unknown_type_fails_unless_allowed(spark):
    df = transactions(spark, [(1, 1, "WIRE", 10.0, 0.0, 5.0, 0)])
    with pytest.raises(Exception, match="unknown transaction type"):
        features.add_features(df).collect()
    row = features.add_features(df, allow_unknown_types=True).first()
    assert sum(row[f"type_{t}"] for t in ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")) == 0
    with pytest.raises(ContractError):
        features.add_features(df.drop("amount"))


def test_feature_groups_sizes():
    assert [len(v) for v in features.FEATURE_GROUPS.values()] == [17, 13, 12, 6, 9]


# Splits and samples


def steps(spark, n, frauds):
    data = []
    for s in range(1, n + 1):
        data.append((2 * s, s, "PAYMENT", 10.0 * s, 100.0, 0.0, 0))
        data.append((2 * s + 1, s, "TRANSFER", 100.0 * s, 1000.0, 0.0, int(s in frauds)))
    return transactions(spark, data)


def test_three_way_split(spark):
    df = steps(spark, 6, range(1, 7))
    bounds = chrono.choose_boundaries(df, 0.6, 0.2)
    assert (bounds.train, bounds.validation) == (4, 5)
    tagged = df.withColumn("split", bounds.split(F.col("step")))
    assert all(r["passed"] for r in chrono.split_checks(df, tagged).collect())
    summary = {r["split"]: r["row_count"] for r in chrono.split_summary(df, bounds).collect()}
    assert summary == {"train": 8, "validation": 2, "test": 2}
    with pytest.raises(ContractError):
        chrono.choose_boundaries(df.where("step < 3"))


def test_train_boundary_never_takes_the_last_two_steps(spark):
    heavy = steps(spark, 3, [1, 2, 3])
    bounds = chrono.choose_boundaries(heavy, 0.98, 0.01)
    assert (bounds.train, bounds.validation) == (1, 2)


def test_split_checks_see_faults(spark):
    df = steps(spark, 6, range(1, 7))
    wrong = df.withColumn("split", F.when(F.col("txn_id") % 2 == 0, "train").otherwise("test"))
    got = {r["check_name"]: r["passed"] for r in chrono.split_checks(df, wrong).collect()}
    assert got == {
        "total_row_conservation": True, "total_fraud_conservation": True,
        "no_step_overlap": False, "chronological_ordering_check": False, "class_coverage_check": False,
    }


def test_inner_split(spark):
    windows = chrono.inner_windows(steps(spark, 10, [3, 7, 10]))
    assert windows["inner_fit"] == chrono.StepWindow(1, 8)
    assert windows["inner_tuning"] == chrono.StepWindow(9, 10)
    counts = chrono.period_counts(steps(spark, 10, [3, 7, 10]), windows)
    assert {r["period"]: r["fraud_count"] for r in counts.collect()} == {"inner_fit": 2, "inner_tuning": 1}
    with pytest.raises(ContractError):
        chrono.inner_windows(steps(spark, 10, [3]))


def test_weighted_sample(spark):
    df = transactions(
        spark, [(s, s, "PAYMENT", 1.0, 1.0, 1.0, int(s in (2, 5, 9))) for s in range(1, 11)]
    )
    sample = sampling.weighted_sample(df, 3)
    assert sample.count() == 6
    assert sample.where("isFraud = 0").select("weight").distinct().first()[0] == pytest.approx(7 / 3)
    assert sample.where("isFraud = 1 AND weight = 1.0").count() == 3
    again = sampling.weighted_sample(df.repartition(5), 3)
    assert sorted(r["txn_id"] for r in sample.collect()) == sorted(r["txn_id"] for r in again.collect())
    meta = one(sampling.sample_metadata(df, sample))
    assert meta["all_frauds_kept"] and meta["weight_matches_counts"]
    shuffled = sampling.permuted_labels(df)
    assert shuffled.count() == 10 and shuffled.agg(F.sum("isFraud")).first()[0] == 3


# Profiles


def test_statistics_of_one_row(spark):
    df = transactions(spark, [(1, 1, "PAYMENT", 4.0, 1.0, 1.0, 1)])
    assert one(profile.amount_statistics(df))["standard_deviation"] == 0.0


def test_histogram_closes_its_right_edge(spark):
    df = transactions(spark, [(i, 1, "PAYMENT", float(i), 1.0, 1.0, 0) for i in range(0, 52)])
    bins = {r["bin"]: r["row_count"] for r in profile.amount_histogram(df).collect()}
    assert sum(bins.values()) == 51 and bins[49] == 2 and max(bins) == 49
    same = df.withColumn("amount", F.lit(3.0))
    assert one(profile.amount_histogram(same))["bin"] == 0


# Evaluation


def test_metrics_by_hand(spark):
    # From the top: 0.95 fraud, 0.6 (fraud, clean), 0.4 clean, 0.15 fraud; then two clean rows.
    df = scored(
        spark, [1, 1, 0, 0, 1, 0, 0], [0.95, 0.6, 0.6, 0.4, 0.15, 0.05, 0.02], [8, 24, 5, 7, 32, 9, 4]
    )
    curve = evaluate.score_curve(df)
    ranking = one(evaluate.ranking_metrics(curve))
    assert ranking["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    # Of 12 fraud-clean pairs 4 + 3.5 + 2 stand the right way round, the tie as a half.
    assert ranking["roc_auc"] == pytest.approx(9.5 / 12)
    at = one(evaluate.threshold_metrics(df, [0.3]))
    counts = [at[k] for k in ("true_positive", "false_positive", "false_negative", "true_negative")]
    assert counts == [2, 2, 1, 2]
    assert at["fraud_amount_recall"] == pytest.approx(32 / 64)
    assert evaluate.precision_recall_curve(curve).count() == 7
    assert one(evaluate.threshold_metrics(df, [1.25]))["threshold"] == 1.0


def test_ties_are_cut_by_id(spark):
    df = scored(spark, [0, 1, 1, 0], [0.5] * 4)
    got = one(evaluate.top_k(df, evaluate.score_curve(df), [50.0]))
    assert (got["reviewed_transactions"], got["frauds_captured"]) == (2, 1)


def test_top_k_with_text_ids_and_nothing_to_review(spark):
    df = scored(spark, [1, 0] * 20, [0.25] * 36 + [0.75] * 4).withColumn("id", F.concat(F.lit("tx-"), "id"))
    made = evaluate.top_k(df, evaluate.score_curve(df), [0.0, 25.0, 100.0])
    got = {r["top_k_percentage"]: r for r in made.collect()}
    assert (got[0.0]["reviewed_transactions"], got[0.0]["frauds_captured"], got[0.0]["precision"]) == (0, 0, 0.0)
    tied = df.where("score = 0.25").orderBy(F.xxhash64("id"), "id").limit(6)
    assert got[25.0]["frauds_captured"] == 2 + tied.agg(F.sum("label")).first()[0]
    assert got[100.0]["frauds_captured"] == 20


def test_top_k_against_brute_force(spark):
    n = 500
    labels = [int(i % 11 == 0) for i in range(n)]
    scores = [(i * 7 % 10) / 10 for i in range(n)]
    amounts = [float(i % 13) for i in range(n)]
    df = scored(spark, labels, scores, amounts)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    for p in (0.1, 3.0, 33.3, 100.0):
        got = one(evaluate.top_k(df, evaluate.score_curve(df), [p]))
        k = min(n, max(1, math.ceil(n * p / 100)))
        chosen = order[:k]
        assert got["reviewed_transactions"] == k
        assert got["frauds_captured"] == sum(labels[i] for i in chosen)
        assert got["fraud_amount_captured"] == pytest.approx(sum(labels[i] * amounts[i] for i in chosen))


def test_no_positives_and_no_rows(spark):
    nothing = {"average_precision": 0.0, "roc_auc": 0.0}
    clean = evaluate.score_curve(df := scored(spark, [0] * 5, [0.45, 0.35, 0.45, 0.85, 0.65]))
    assert one(evaluate.ranking_metrics(clean)) == nothing
    review = one(evaluate.top_k(df, clean, [40.0]))
    assert (review["reviewed_transactions"], review["frauds_captured"], review["recall"]) == (2, 0, 0.0)
    assert {r["threshold"] for r in evaluate.best_thresholds(clean).collect()} == {0.35}
    empty = evaluate.score_curve(scored(spark, [], []))
    assert one(evaluate.ranking_metrics(empty)) == nothing
    assert one(evaluate.score_summary(empty))["maximum"] == 0.0


def test_best_threshold_prefers_the_lowest(spark):
    df = scored(spark, [1, 0, 1], [0.9, 0.6, 0.3])
    best = {r["objective"]: r for r in evaluate.best_thresholds(evaluate.score_curve(df)).collect()}
    assert best["best_f1"]["threshold"] == 0.3 and best["best_f1"]["f1"] == pytest.approx(0.8)


def test_metric_reports(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("x", 1.0 + 1e-12), ("z", 2.0)], "metric string, value double")
    got = {r["metric"]: r["matches"] for r in evaluate.metrics_match(a, b).collect()}
    assert got == {"x": True, "y": False, "z": False}
    assert not one(evaluate.all_match(evaluate.metrics_match(a, b)))["all_match"]
    zero = spark.createDataFrame([("x", 0.0)], "metric string, value double")
    assert one(evaluate.compare_periods(zero, a))["relative_change"] is None
    flat = evaluate.flatten_params({"a": {"b": 1, "c": [1, 2]}, "d": None})
    assert flat == {"a_b": 1, "a_c": "[1,2]"}


# Shortcuts


def test_rules(spark):
    df = transactions(spark, [(1, 1, "TRANSFER", 100.0, 100.0, 0.0, 1), (2, 2, "CASH_OUT", 50.0, 0.0, 10.0, 0)])
    rows = df.select("txn_id", *[c.alias(n) for n, c in shortcuts.rules().items()]).orderBy("txn_id").collect()
    assert [r["oldbalanceOrg_equals_amount"] for r in rows] == [True, False]
    assert [r["amount_ge_oldbalanceOrg"] for r in rows] == [True, True]
    assert [r["transfer_and_oldbalanceDest_zero"] for r in rows] == [True, False]


def test_duplicate_classes(spark):
    def row(i, step, amount, fraud):
        return (i, step, "PAYMENT", amount, 1.0, 1.0, fraud)

    train = [row(1, 1, 5.0, 0), row(2, 1, 6.0, 1), row(3, 1, 7.0, 0), row(4, 1, 7.0, 1)]
    check = [row(5, 1, 5.0, 0), row(6, 1, 5.0, 1), row(7, 1, 6.0, 1), row(8, 1, 7.0, 0), row(9, 1, 8.0, 0)]
    df = transactions(spark, train + check)
    got = one(shortcuts.duplicate_patterns(df, F.col("txn_id") <= 4, F.col("txn_id") > 4))
    assert got["unique_train_feature_patterns"] == 3 and got["matching_validation_rows"] == 4
    assert got["matching_same_label_rows"] == 2 and got["matching_opposite_label_rows"] == 1
    assert got["matching_mixed_train_label_rows"] == 1 and got["matching_validation_percentage"] == 80.0


def test_patterns_round_half_even(spark):
    df = transactions(spark, [(i, 1, "PAYMENT", a, 1.0, 1.0, 0) for i, a in ((1, 5.00001), (2, 5.00002))])
    exact = df.select(shortcuts.pattern_columns()["log_amount"].alias("x")).distinct().count()
    coarse = df.select(shortcuts.pattern_columns(3)["log_amount"].alias("x")).distinct().count()
    assert (exact, coarse) == (2, 1)


def test_patterns_round_the_float_itself(spark):
    """These logarithms lie beside a half of a thousandth, but on it once multiplied as floats."""
    df = transactions(spark, [(i, 1, "PAYMENT", 1.0, b, 1.0, 0) for i, b in enumerate((47.40, 47.74, 15.42))])
    got = df.orderBy("txn_id").select(shortcuts.pattern_columns(3)["log_oldbalance_origin"].cast("string").alias("x"))
    assert [r["x"] for r in got.collect()] == ["3.879", "3.887", "2.799"]


# Ledger


def test_intake_statuses(spark):
    df = spark.createDataFrame(
        [("r", 1, "a"), ("r", 2, "a"), ("r", 3, "b"), ("s", 1, "c")],
        "request_id string, attempt bigint, payload_hash string",
    )
    got = {(r["request_id"], r["attempt"]): r["status"] for r in ledger.classify_attempts(df).collect()}
    assert got == {("r", 1): "new", ("r", 2): "replay", ("r", 3): "conflict", ("s", 1): "new"}
    stored = spark.createDataFrame([("r", "b")], "request_id string, payload_hash string")
    got = {(r["request_id"], r["attempt"]): r["status"] for r in ledger.classify_attempts(df, stored=stored).collect()}
    assert got == {("r", 1): "conflict", ("r", 2): "conflict", ("r", 3): "replay", ("s", 1): "new"}


def test_payload_hash_depends_on_order(spark):
    body = "array<struct<step:bigint,amount:double>>"
    df = spark.createDataFrame(
        [("/p", [(1, 2.0), (2, 3.0)]), ("/p", [(2, 3.0), (1, 2.0)]), ("/p", [(1, 2.0), (2, 3.0)])],
        f"endpoint string, transactions {body}",
    )
    h = [r[0] for r in df.select(ledger.payload_hash(F.col("endpoint"), F.col("transactions"))).collect()]
    assert h[0] == h[2] != h[1] and len(h[0]) == 64


def test_outcome_batches(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "prediction_id string")
    stored = spark.createDataFrame([("c", 1)], "prediction_id string, actual_fraud int")
    sent = spark.createDataFrame(
        [("1", 1, "a", 1), ("1", 2, "a", 1), ("1", 3, "c", 1), ("2", 4, "b", 0), ("2", 5, "zz", 0),
         ("3", 6, "b", 0), ("3", 7, "b", 1), ("4", 8, "c", 0)],
        "batch_id string, position int, prediction_id string, actual_fraud int",
    )
    admitted = ledger.admit_batches(sent, known, stored)
    assert {r["batch_id"]: r["admitted"] for r in admitted.collect()} == {"1": True, "2": False, "3": False, "4": False}
    merged = ledger.merge_outcomes(sent, admitted, stored)
    assert {r["position"]: r["replayed"] for r in merged.collect()} == {1: False, 2: True, 3: True}


def test_refused_batches_leave_no_trace(spark):
    known = spark.createDataFrame([(c,) for c in "abcde"], "prediction_id string")
    stored = spark.createDataFrame([], "prediction_id string, actual_fraud int")
    sent = [
        ("r", "a", 0), ("r", "no such id", 0),  # refused
        ("s", "a", 1), ("s", "b", 1),  # sound; clashes with refused r only
        ("t", "b", 0), ("t", "c", 0),  # clashes with s
        ("u", "c", 1),  # clashes with refused t only
        ("v", "c", 0), ("v", "b", 0), ("v", "b", 0),  # clashes with u and twice with s
        *[("w", "d", 1)] * 4,  # too large
        ("x", "d", 0), ("x", "e", 0),
    ]
    sent = spark.createDataFrame(
        [(b, i, p, y) for i, (b, p, y) in enumerate(sent)],
        "batch_id string, position int, prediction_id string, actual_fraud int",
    )
    verdict = ledger.admit_batches(sent, known, stored, max_submissions=3)
    got = {r["batch_id"]: (r["admitted"], r["unknown_ids"], r["earlier_conflicts"], r["oversize"]) for r in verdict.collect()}
    assert got == {
        "r": (False, 1, 0, False), "s": (True, 0, 0, False), "t": (False, 0, 1, False),
        "u": (True, 0, 0, False), "v": (False, 0, 3, False), "w": (False, 0, 0, True),
        "x": (True, 0, 0, False),
    }
    merged = ledger.merge_outcomes(sent, verdict, stored).where("NOT replayed")
    assert {r["prediction_id"]: r["actual_fraud"] for r in merged.collect()} == {"a": 1, "b": 1, "c": 1, "d": 0, "e": 0}


def plain_walk(rows):
    """Batches one after the other: {batch: clashing rows}."""
    labels, out = {}, {}
    for order in sorted({o for _, _, _, _, o in rows}):
        mine = [r for r in rows if r[4] == order]
        clash = sum(n for _, p, n, y, _ in mine if labels.get(p, y) != y)
        out[mine[0][0]] = clash
        if not clash:
            labels.update((p, y) for _, p, _, y, _ in mine)
    return {b: n for b, n in out.items() if n}


CLASHES = "batch_id string, prediction_id string, _n bigint, _label int, _order bigint"


@pytest.mark.parametrize("slab_rows", [200_000, 100])
def test_label_clashes_walked_in_slabs(spark, slab_rows):
    r = random.Random(4)
    rows = [(f"b{b}", f"p{p}", r.randint(1, 3), int(r.random() < 0.15), b * 7) for b in range(200) for p in r.sample(range(150), 4)]
    got = ledger._later_clashes(spark.createDataFrame(rows, CLASHES), slab_rows).where("earlier_conflicts > 0").collect()
    assert {x["batch_id"]: x["earlier_conflicts"] for x in got} == plain_walk(rows)


def test_a_long_chain_of_clashes_needs_no_more_jobs(spark):
    jobs = {}
    for length in (10, 1000):
        # every batch clashes with the one before it: each second one is refused
        rows = [(f"b{b}", f"p{p}", 1, b % 2, b) for b in range(length) for p in (b, b + 1)]
        df = spark.createDataFrame(rows, CLASHES)
        spark.sparkContext.setJobGroup(f"chain-{length}", "")
        got = {x["batch_id"]: x["earlier_conflicts"] for x in ledger._later_clashes(df).collect()}
        jobs[length] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{length}"))
        assert {b for b, n in got.items() if n} == {f"b{b}" for b in range(1, length, 2)}
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs[10] == jobs[1000]


def test_window_edges(spark):
    end = datetime(2026, 1, 3, tzinfo=timezone.utc)
    start = end - timedelta(hours=24)
    at = [start, end - timedelta(microseconds=1), end]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "prediction_id bigint, created_at timestamp")
    none = spark.createDataFrame([], "prediction_id bigint, actual_fraud int")
    assert sorted(r["prediction_id"] for r in ledger.window_events(df, none, start, end).collect()) == [0, 1]
    with pytest.raises(ValueError):
        ledger.window_events(df, none, datetime(2026, 1, 1), end)


# Drift


def numeric_drift(spark, counts, reference, transformation="identity", least=1):
    """Drift of a feature with ``counts[v]`` rows of value v against ``reference`` rows per bin [2i, 2i+2)."""
    edges = [2.0 * i for i in range(len(reference) + 1)]
    if transformation == "log1p":
        edges = [math.log1p(e) for e in edges]
    p = drift.NumericProfile("load", "load", transformation, edges, list(reference))
    df = spark.createDataFrame([(float(v),) for v, n in counts.items() for _ in range(n)], "load double")
    config = drift.MonitoringConfig(minimum_events=least)
    return one(drift.feature_drift(df, drift.ReferenceProfile("v", [p], []), config))


@pytest.mark.parametrize("transformation", ["identity", "log1p"])
def test_numeric_psi(spark, transformation):
    def psi(shares, reference):
        return sum((c - r) * math.log(c / r) for c, r in zip(shares, reference, strict=True))

    got = numeric_drift(spark, {1: 6, 3: 8, 5: 6}, [30, 40, 30], transformation)
    assert got["psi"] == pytest.approx(0.0, abs=1e-12) and got["severity"] == "stable"
    got = numeric_drift(spark, {1: 5, 3: 6, 5: 9}, [30, 40, 30], transformation)
    assert got["psi"] == pytest.approx(psi([0.25, 0.3, 0.45], [0.3, 0.4, 0.3])) and got["severity"] == "stable"
    got = numeric_drift(spark, {1: 3, 3: 7, 5: 10}, [30, 40, 30], transformation)
    assert got["psi"] == pytest.approx(psi([0.15, 0.35, 0.5], [0.3, 0.4, 0.3])) and got["severity"] == "moderate"
    got = numeric_drift(spark, {1: 16, 3: 2, 5: 2}, [30, 40, 30], transformation)
    assert got["psi"] == pytest.approx(psi([0.8, 0.1, 0.1], [0.3, 0.4, 0.3])) and got["severity"] == "significant"
    # Values beyond the last edge belong to the last bin.
    got = numeric_drift(spark, {0: 6, 3: 8, 777: 6}, [30, 40, 30], transformation)
    assert got["psi"] == pytest.approx(0.0, abs=1e-12)
    got = numeric_drift(spark, {1: 4, 5: 2}, [30, 40, 30], transformation, least=7)
    assert (got["psi"], got["severity"], got["sample_size"]) == (None, "insufficient_data", 6)


def test_log_of_a_negative_value_fails(spark):
    with pytest.raises(Exception, match="non-negative"):
        numeric_drift(spark, {-3: 4, 1: 4}, [1, 1], "log1p")


def test_categorical_psi(spark):
    p = drift.CategoricalProfile("kind", "kind", ["A", "B"], [5, 5, 0])
    reference = drift.ReferenceProfile("v", [], [p])
    df = spark.createDataFrame([(v,) for v in ["A"] * 5 + ["B"] * 4 + [None]], "kind string")
    counts = {r["bucket"]: r["n"] for r in drift.bucket_counts(df, reference).collect()}
    assert counts == {0: 5, 1: 4, 2: 1}
    got = one(drift.feature_drift(df, reference, drift.MonitoringConfig(minimum_events=10)))
    want = (0.4 - 0.5) * math.log(0.8) + (0.1 - 1e-6) * math.log(0.1 / 1e-6)
    assert got["psi"] == pytest.approx(want)
    assert drift.ReferenceProfile.from_json(reference.to_json()) == reference


def test_constant_feature_gives_one_bin(spark):
    df = transactions(spark, [(i, 1, "PAYMENT", 5.0, 1.0, float(i), 0) for i in range(30)])
    frozen = drift.freeze_profile(df)
    step = next(p for p in frozen.numeric if p.feature == "step")
    assert step.edges == [1.0, 1.0] and step.counts == [30]


def labelled(spark, data):
    return spark.createDataFrame(data, "prediction int, actual_fraud int, amount double")


def test_performance(spark):
    data = [(1, 1, 40.0), (1, 1, 60.0), (0, 1, 50.0), (1, 0, 20.0), (1, 0, 10.0), (0, 0, 30.0), (0, 0, 40.0)]
    got = one(drift.performance(labelled(spark, data), 7))
    assert got["status"] == "available" and got["labeled_count"] == 7
    assert got["precision"] == pytest.approx(0.5) and got["recall"] == pytest.approx(2 / 3)
    assert got["f1"] == pytest.approx(4 / 7) and got["f2"] == pytest.approx(0.625)
    assert got["false_positive_rate"] == pytest.approx(0.5)
    assert got["fraud_amount_recall"] == pytest.approx(2 / 3)
    few = drift.performance(labelled(spark, data[:1] + [(1, None, 5.0)]), 2)
    assert one(few)["status"] == "insufficient_labeled_data"
    assert [r["metric_name"] for r in drift.performance_metrics(few).collect()] == ["performance_available"]
    with pytest.raises(Exception, match="labels must be"):
        drift.performance(labelled(spark, [(1, 3, 1.0)]), 1).collect()


def test_empty_window_gives_nulls_not_zeros(spark):
    df = spark.createDataFrame([], "prediction int, risk_level string, fraud_score double")
    rows = drift.output_metrics(df, {"": F.lit(True)}).collect()
    assert len(rows) == 7 and {r["severity"] for r in rows} == {"unavailable"}
    assert all(r["metric_value"] is None for r in rows)


# Gates, certificates, promotion


@pytest.fixture(scope="module")
def train(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        fraud = int(r.random() < 0.3)
        rows.append((i, 1 + i % 90, "TRANSFER" if fraud or r.random() < 0.3 else "PAYMENT", r.lognormvariate(4 + fraud, 1), r.uniform(0, 500), r.uniform(0, 500), fraud))
    schema = "txn_id bigint, step bigint, type string, amount double, oldbalanceOrg double, oldbalanceDest double, isFraud int"
    return spark.createDataFrame(rows, schema).repartition(2).cache()


def test_fits_refuse_one_class_other_columns_and_infinite_values(spark, train):
    with pytest.raises(ContractError, match="both classes"):
        models.fit_logistic(train.where("isFraud = 0"))
    with pytest.raises(ContractError, match="both classes"):
        models.fit_trees(train.where("isFraud = 1"), {"max_depth": 2, "learning_rate": 0.1}, 1)
    with pytest.raises(ContractError, match="newbalanceOrig"):
        models.fit_logistic(train, names=["log_amount", "newbalanceOrig"])
    broken = train.withColumn("amount", F.when(F.col("txn_id") == 7, float("inf")).otherwise(F.col("amount")))
    with pytest.raises(Exception, match="is not finite"):
        models.fit_logistic(broken)
    with pytest.raises(Exception, match="is not finite"):
        models.score_candidates(broken, {"model": F.col("log_amount") * 0.5}).collect()


def test_requests_hold_model_inputs_only(spark):
    items = "step bigint, type string, amount double, oldbalanceOrg double, oldbalanceDest double"
    asked = spark.createDataFrame([], f"request_id string, transactions array<struct<{items}, newbalanceOrig: double>>")
    with pytest.raises(ContractError, match="newbalanceOrig"):
        request_items(asked)


def test_a_stream_score_must_be_finite(spark, train):
    rows = train.select("step", "type", "amount", "oldbalanceOrg", "oldbalanceDest")
    assert score_rows(rows, F.lit(0.25)).where("fraud_score = 0.25").count() == 400
    for wrong in (F.lit(float("nan")), F.lit(1.5), F.lit(None).cast("double")):
        with pytest.raises(Exception, match="no finite score"):
            score_rows(rows, wrong).collect()


def test_certificate_of_a_fit(spark, train):
    names = ["log_amount", "type_TRANSFER"]
    model = models.fit_logistic(train, alpha=1e-2, epochs=40, names=names)
    got = one(models.optimality(model, train, alpha=1e-2))
    assert got["row_count"] == 400 and got["residual"] < 1e-4 < got["start"]
    local = models.add_features(train, keep=["isFraud"]).collect()
    z = [[(r[n] - m) / s for n, m, s in zip(names, model.means, model.scales)] for r in local]
    p = [1 / (1 + math.exp(-(model.intercept + sum(w * x for w, x in zip(model.weights, row))))) for row in z]
    gradient = [sum((q - r["isFraud"]) * row[k] for q, r, row in zip(p, local, z)) / 400 + 1e-2 * model.weights[k] for k in range(2)]
    gradient.append(sum(q - r["isFraud"] for q, r in zip(p, local)) / 400)
    assert got["residual"] == pytest.approx(max(map(abs, gradient)), abs=1e-9)
    moved = dataclasses.replace(model, weights=[model.weights[0] + 0.1, model.weights[1]])
    assert one(models.optimality(moved, train, alpha=1e-2))["residual"] > 1e-3


def test_features_are_derived_once_for_all_fits_of_a_search(spark, train, monkeypatch):
    made, derive = [], models.finite_features

    def counted(df, keep):
        made.append(keep)
        return derive(df, keep)

    monkeypatch.setattr(models, "finite_features", counted)
    trials = models.logistic_trials(limit=3)
    _, fitted = models.logistic_search(train, train, trials)
    assert len(made) == 2  # for the fits, and for the scores
    t = trials[1]
    alone = models.fit_logistic(train, sampling.positive_weight(t["positive_class_weight"]), t["alpha"], t["epochs"])
    assert fitted[t["trial_id"]].weights == pytest.approx(alone.weights, abs=1e-9)
    prepared = models.fit_rows(train)
    del made[:]
    assert one(models.optimality(alone, prepared))["row_count"] == 400 and models.fit_logistic(prepared).weights and not made


def test_permutation_fit_draws_its_sample_once(spark, train, monkeypatch):
    """The plan that a fit reads several times holds neither the hashes of the draw nor those of the shuffle."""
    plans, fit = [], models.fit_trees

    def seen(rows, *args, **kwargs):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return fit(rows, *args, **kwargs)

    monkeypatch.setattr(models, "fit_trees", seen)
    got = one(models.permutation_test(train, train, max_negatives=100, rounds=2))
    assert got["evaluation_rows"] == 400 and len(plans) == 1 and "sha2" not in plans[0]


def test_promotion_needs_every_number(spark, train):
    model = models.fit_logistic(train)
    scored = models.score_candidates(train, {"m": model.score()}).cache()
    record = models.recorded_model(model, scored, 0.3).cache()
    assert models.model_of(record) == model
    assert one(evaluate.all_match(models.promotion_check(record, scored, 0.3)))["all_match"]

    def fails(section, name, by):
        changed = F.when((F.col("section") == section) & (F.col("name") == name), F.col("value") + by).otherwise(F.col("value"))
        report = models.promotion_check(record.withColumn("value", changed), scored, 0.3)
        return [r["metric"] for r in report.where("NOT matches").collect()]

    assert fails("metric", "average_precision", 2e-6) == ["average_precision"] and not fails("metric", "average_precision", 5e-7)
    assert fails("metric", "recall", 2e-5) == ["recall"] and not fails("metric", "recall", 5e-6)
    assert fails("matrix", "true_negative", 1.0) == ["true_negative"]
    lost = models.promotion_check(record.where("name <> 'roc_auc'"), scored, 0.3)
    assert [r["metric"] for r in lost.where("NOT matches").collect()] == ["roc_auc"]


# Series


def test_status_class(spark):
    df = spark.createDataFrame([(99,), (200,), (404,), (503,), (700,)], "s int")
    assert [r[0] for r in df.select(status_class(F.col("s"))).collect()] == ["1xx", "2xx", "4xx", "5xx", "5xx"]


def test_alert_needs_an_unbroken_stretch(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    minutes = [0, 5, 10, 20, 25]
    df = spark.createDataFrame([(at + timedelta(minutes=m), m != 25) for m in minutes], "window_start timestamp, bad boolean")
    got = one(series.sustained(df, F.col("bad"), 300))
    assert got["points"] == 3 and got["firing_since"] == got["pending_since"] + timedelta(minutes=5)


GAUGES = {
    # seconds of the samples and their values: one that fires, one that just does not
    "not_ready": ("ready", [(0, 0), (45, 0), (60, 1)], [(0, 0), (45, 0), (59, 1)]),
    "target_down": ("up", [(0, 1), (10, 0), (70, 1)], [(0, 1), (11, 0), (70, 1)]),
    # the second goes stale before it has lasted: a sample counts for 300 seconds
    "significant_drift": ("drift_severity", [(0, 2), (240, 2)], [(0, 1), (1, 2), (300, 1)]),
}


@pytest.mark.parametrize("alert", sorted(GAUGES))
def test_gauge_rules_fire_and_just_do_not(spark, alert):
    gauge, fires, rests = GAUGES[alert]
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    samples = [(at + timedelta(seconds=s), gauge, name, v) for name, vs in (("fires", fires), ("rests", rests)) for s, v in vs]
    got = one(series.gauge_alerts(spark.createDataFrame(samples, "ts timestamp, gauge string, instance string, value int")))
    first = next(s for s, v in fires if v == (2 if gauge == "drift_severity" else 0))
    assert (got["alert"], got["instance"]) == (alert, "fires")
    assert got["pending_since"].timestamp() == (at + timedelta(seconds=first)).timestamp()


def test_stale_gauges_break_a_stretch(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    samples = [(at + timedelta(seconds=s), s, True) for s in (0, 50, 400, 700, 1000)]
    df = spark.createDataFrame(samples, "ts timestamp, s int, bad boolean")
    got = series.gauge_intervals(df, F.col("bad"), 360, 300).collect()
    seconds = sorted((r["pending_since"].timestamp() - at.timestamp(), r["ended_at"].timestamp() - at.timestamp()) for r in got)
    assert seconds == [(400, 1300)]


@pytest.mark.parametrize("pieces", [0, 1, 7, 200])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_gauge_stretches_do_not_depend_on_slabs(spark, pieces, kind):
    """One gauge that holds all samples is ordered slab by slab; whatever the cuts, a plain loop gives the same."""
    r, at = random.Random(pieces), datetime(2024, 3, 30, 23, tzinfo=timezone.utc)  # a night in which clocks change
    moments = {g: sorted(r.sample(range(0, 20_000), 400)) for g in "ab"}
    samples = [(g, s, r.random() < 0.8) for g, ss in moments.items() for s in ss] + [("b", s, False) for s in moments["b"][::50]]
    rows = [(at + timedelta(seconds=s), g, ok) for g, s, ok in samples] + [(None, "a", True)]
    df = spark.createDataFrame(rows, "ts timestamp, g string, bad boolean").withColumn("ts", F.col("ts").cast(kind))
    want = []
    for g in "ab":
        all_of = {}
        for h, s, ok in samples:
            if h == g:
                all_of[s] = all_of.get(s, True) and ok
        times, begun = sorted(all_of), None
        for k, s in enumerate(times):
            end = min(s + 90, times[k + 1] if k + 1 < len(times) else s + 90)
            if all_of[s]:
                begun = s if begun is None else begun
            if begun is not None and (not all_of[s] or k + 1 == len(times) or end < times[k + 1] or not all_of[times[k + 1]]):
                want += [(g, begun, end)] if end - begun >= 120 else []
                begun = None
    cuts = sorted({at.timestamp() + r.uniform(-100, 20_100) for _ in range(pieces)})
    got = series.gauge_intervals(df, F.col("bad"), 120, 90, by=["g"], cuts=cuts)
    start = F.lit(at.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + "+00:00").cast("timestamp").cast(kind)
    seconds = [F.unix_timestamp(F.col(c).cast("timestamp")) - F.unix_timestamp(start.cast("timestamp")) for c in ("pending_since", "ended_at")]
    assert len(want) > 20 and sorted(tuple(x) for x in got.select("g", *seconds).collect()) == sorted(want)


@pytest.mark.parametrize("bad,fires", [({0: 600, 5: 600}, True), ({0: 600, 10: 600}, False), ({0: 40, 5: 600}, False)])
def test_window_rules_fire_and_just_do_not(spark, bad, fires):
    """Error rate and latency: a window counts from more than 5 % failures and 1 s."""
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    log = [(at + timedelta(minutes=m, milliseconds=200 * i), "/x", 2.0 if i < n else 0.01, 503 if i < n else 200) for m, n in bad.items() for i in range(1000)]
    df = spark.createDataFrame(log, "ts timestamp, route string, duration_seconds double, status int")
    assert {r["alert"] for r in series.operational_alerts(df).collect()} == ({"high_error_rate", "high_p95_latency"} if fires else set())


def test_stale_intervals_open_and_without_success(spark):
    at = datetime(2024, 3, 1, tzinfo=timezone.utc)
    calls = [("/ok", m, True) for m in range(0, 61, 5)]
    calls += [("/down", 0, True), ("/down", 20, False), ("/down", 40, False)]
    calls += [("/never", 10, False), ("/never", 30, False)]
    calls += [("/slow_start", 5, False), ("/slow_start", 45, True), ("/slow_start", 60, True)]
    df = spark.createDataFrame(
        [(r, at + timedelta(minutes=m), ok) for r, m, ok in calls], "route string, ts timestamp, ok boolean"
    )
    made = series.stale_intervals(df, F.col("ok"), ["route"], limit_seconds=900, hold_seconds=60)

    def minute(t):
        return None if t is None else (t.timestamp() - at.timestamp()) / 60

    got = {
        (r["route"], minute(r["last_success"]), minute(r["firing_since"]), minute(r["resolved_at"]))
        for r in made.select(
            "route", *[F.col(c) for c in ("last_success", "firing_since", "resolved_at")]
        ).collect()
    }
    assert got == {("/down", 0, 16, None), ("/never", None, 26, None), ("/slow_start", None, 21, 45)}


def test_latency_quantile_interpolates(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(at, "/x", d) for d in [0.3] * 10 + [9.0] * 10], "ts timestamp, route string, duration_seconds double")
    got = one(series.latency_quantiles(df))
    assert got["p50"] == pytest.approx(0.5) and got["p99"] == 5.0


# Models


def test_trials():
    trials = models.logistic_trials()
    assert len(trials) == 12 == len({t["trial_id"] for t in trials})
    for key in ("alpha", "epochs", "positive_class_weight"):
        assert len({t[key] for t in trials}) >= 3
    every = models.logistic_trials(limit=1000)
    assert len(every) == 3 * 3 * 6 == len({t["trial_id"] for t in every})
    trees = models.tree_trials()
    assert len(trees) == 8 == len({t["trial_id"] for t in trees}) and trees == models.tree_trials()
    assert trees != models.tree_trials(seed=7)
    with pytest.raises(ContractError, match="reg_alpha"):
        models.fit_trees(None, {"max_depth": 3, "learning_rate": 0.1, "reg_alpha": 1.0}, 5)


def test_logistic_model_beats_the_prior(spark, small_dir):
    rows = canonical.transactions(spark, small_dir)
    model = models.fit_logistic(rows, sampling.positive_weight(5.0))
    prior = models.prior_score(rows)
    made = evaluate.evaluation_bundle(
        models.score_candidates(rows, {"model": model.score(), "prior_probability": prior})
    )
    got = {r["candidate"]: r["average_precision"] for r in made.collect()}
    assert got["model"] > got["prior_probability"] > 0
    with pytest.raises(ContractError):
        models.require_both_classes(rows.where("isFraud = 0"))


def test_scaler_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = {r["feature"]: (r["mean"], r["scale"]) for r in models.scaler_statistics(df, ["a", "b"]).collect()}
    assert got == {"a": (2.0, 1.0), "b": (5.0, 1.0)}


def test_frozen_score(spark):
    df = spark.createDataFrame([(3.0,)], "a double")
    assert df.select(logistic_score(["a"], [1.0], [2.0], [0.5], 0.25)).first()[0] == pytest.approx(1 / (1 + math.exp(-0.75)))


def test_champions(spark):
    names = "candidate string, average_precision double, selected_f_beta double, selected_alert_rate double, top_0_5_fraud_amount_recall double, cost_1 double, cost_2 double"
    same = [("prior_probability", 0.5, 0.5, 0.1, 0.1, 1.0, 1.0), ("unweighted_logistic", 0.6, 0.5, 0.1, 0.1, 1.0, 3.0),
            ("weighted_logistic", 0.6, 0.5, 0.1, 0.1, 1.0, 2.0)]
    df = spark.createDataFrame(same, names)
    got = one(models.baseline_champion(df))
    assert got == {"champion": "unweighted_logistic", "prior_eligible": False}
    assert one(models.rank_trials(df.where("candidate <> 'prior_probability'")))["best_trial"] == "weighted_logistic"
    kept = one(models.challenger_champion(df, "unweighted_logistic", "weighted_logistic"))
    assert kept["champion"] == "unweighted_logistic" and kept["improvement"] == pytest.approx(0.0)
    low = spark.createDataFrame([("prior_probability", 0.7, 0.5, 0.1, 0.1, 1.0, 1.0), *same[1:]], names)
    assert one(models.baseline_champion(low))["champion"] == "prior_probability"


def plain_cut(counts, target, places):
    """Of the chosen places the step whose cumulative rows are nearest the target."""
    order, seen, best = sorted(counts), 0, None
    for i, step in enumerate(order):
        seen += counts[step]
        if i in places and (best is None or abs(seen - target) < best[0]):
            best = (abs(seen - target), step)
    return best[1]


@pytest.mark.parametrize("spread, nulls", [(1, 0), (1, 90), (5000, 40)])
def test_boundaries_against_brute_force(spark, spread, nulls):
    counts = {3 + s * spread: 1 + (s * 7) % 11 + 30 * (s == 12) for s in range(25)}
    data = [(i, s, "PAYMENT", 1.0, 1.0, 1.0, int(i % 5 == 0)) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    data += [(10_000 + i, None, "PAYMENT", 1.0, 1.0, 1.0, 1) for i in range(nulls)]
    df, total = transactions(spark, data), sum(counts.values())
    for train, validation in ((0.7, 0.15), (0.5, 0.25), (0.93, 0.05)):
        got = chrono.choose_boundaries(df, train, validation)
        assert got.train == plain_cut(counts, total * train, range(23))
        later = [i for i, s in enumerate(sorted(counts)) if 1 <= i < 24 and s > got.train]
        assert got.validation == plain_cut(counts, total * (train + validation), later)
    bounds = chrono.choose_boundaries(df)
    kept = {s: n for s, n in counts.items() if s <= bounds.train}
    cut = plain_cut(kept, sum(kept.values()) * 0.8, range(len(kept) - 1))
    want = (chrono.StepWindow(3, cut), chrono.StepWindow(min(s for s in kept if s > cut), bounds.train))
    periods = chrono.audit_periods(df)
    assert (periods["inner_fit"], periods["inner_tuning"]) == want
    assert tuple(chrono.inner_windows(df.where(F.col("step") <= bounds.train)).values()) == want
    with pytest.raises(ContractError):
        chrono.choose_boundaries(df, 0.8, 0.2)


def test_nth_smallest_with_an_id_that_repeats(spark):
    df = spark.range(90).select((F.when(F.col("id") < 60, 7).otherwise(F.col("id"))).alias("key"))
    df = df.withColumn("id", F.col("key") * 10)
    for n in (1, 30, 60, 61):
        want = (7, 70) if n <= 60 else (60, 600)
        assert ordered.nth_smallest(df, n, "key", "id") == want


def test_nth_smallest_narrows_to_a_tied_key(spark):
    df = spark.range(300).select((F.col("id") % 2 * 5).alias("key"), "id")
    want = sorted((i % 2 * 5, i) for i in range(300))
    for n in (1, 100, 150, 151, 299):
        assert ordered.nth_smallest(df, n, "key", "id") == want[n - 1]
    assert ordered.nth_smallest(df, 300, "key", "id") is None


ODD_DOUBLES = [0.0, -0.0, 1.0, -1.0, 0.1, -0.3, 2.0**60, 2.0**-60, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf")]


def test_order_bits_are_those_of_the_double(spark):
    r = random.Random(1)
    values = ODD_DOUBLES + [struct.unpack("<d", struct.pack("<q", r.getrandbits(63)))[0] for _ in range(2000)]
    values += [2.0**e * (1 + d) for e in range(-40, 40) for d in (0, 2.0**-52, -(2.0**-53))]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", ordered.order_bits(F.col("v")))
    for row in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(row["v"])))[0]
        assert row["b"] == (-bits if row["v"] < 0 else bits) and ordered.of_bits(row["b"]) == row["v"]


def test_quantiles_by_radix_selection(spark):
    r = random.Random(2)
    groups = {"ties": [1.5] * 300 + [2.5] * 300, "one": [7.0], "odd": ODD_DOUBLES[:13], None: [r.gauss(0, 1e3) for _ in range(500)] + [0.25] * 250, "spread": [r.random() * 10.0 ** r.randint(-9, 9) for _ in range(400)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None)], "g string, v double")
    points = {f"q{i}": q for i, q in enumerate([0.0, 0.1, 0.25, 0.5, 0.95, 0.999, 1.0])}
    got = {row["g"]: row for row in ordered.exact_quantiles(df.repartition(7), "v", points, by=["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = sorted(vs)
        for name, q in points.items():
            h = (len(s) - 1) * q
            low, high = s[math.floor(h)], s[math.ceil(h)]
            assert got[g][name] == (low if low == high else low + (high - low) * (h - math.floor(h)))
        assert got[g]["n"] == len(s)


def test_selection_shuffles_no_rows(spark):
    df = spark.range(200_000).select((F.col("id") % 50).cast("double").alias("v"))
    bits = df.select(ordered.order_bits(F.col("v")).alias("b"))
    counts = bits.groupBy(F.shiftright("b", 52)).count()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.rindex("partial_count")  # folded before the exchange
    nan = df.unionByName(spark.createDataFrame([(float("nan"),)] * 3, "v double"))
    got = one(ordered.exact_quantiles(nan, "v", {"a": 0.0, "z": 1.0}))
    assert got["a"] == 0.0 and math.isnan(got["z"]) and got["n"] == 200_003

