"""Fitting, scoring, searching and selecting classifiers with Spark ML.

Fits are distributed by Spark ML. A fitted linear model is frozen to literals and scores as a
plain column expression, the same in batch and stream. All candidates of a comparison are
scored once into a narrow checkpointed table and evaluated together from there, so no model
runs again for another metric and a lost executor costs no refit.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.exprs import is_finite, logistic_score
from tollgate.functions.features import FEATURE_GROUPS, FEATURES, add_features
from tollgate.operators.evaluate import compared_metrics, evaluation_bundle, threshold_metrics
from tollgate.operators.sampling import permuted_labels, positive_weight, weighted_sample
from tollgate.schemas import TARGET, ContractError
from tollgate.session import checkpointed

# Search spaces. Leaf penalties are left out: Spark ML has none, and trials that
# differ only there would be the same fit twice.
LOGISTIC_SPACE = {
    "positive_class_weights": [1.0, 2.0, 5.0, 10.0, 25.0, 50.0],
    "alpha_values": [0.00001, 0.0001, 0.001],
    "epoch_values": [2, 3, 5],
}
TREE_SPACE = {
    "max_depth": [3, 5, 7],
    "learning_rate": [0.03, 0.05, 0.1],
    "n_estimators": [200, 400, 700],
    "min_child_weight": [1, 5, 10],
    "subsample": [0.7, 0.85, 1.0],
    "colsample_bytree": [0.7, 0.85, 1.0],
}
MINIMUM_IMPROVEMENT = 0.001
RECORD_SCHEMA = "section string, name string, value double"
# A fit whose gradient has come down to this share of where it began counts as done.
RESIDUAL_SHARE = 0.05

# An epoch of stochastic steps over all rows does about what five full-gradient steps do.
ITERATIONS_PER_EPOCH = 5
GOLDEN = (math.sqrt(5) - 1) / 2


@dataclass(frozen=True)
class LinearModel:
    """Frozen standardised logistic model."""

    features: list[str]
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        return logistic_score(self.features, self.means, self.scales, self.weights, self.intercept)


def scaler_statistics(features: DataFrame, names: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """mean and population standard deviation per feature; a constant feature has scale 1."""
    wide = features.agg(
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[F.stddev_pop(n).alias(f"s_{n}") for n in names],
    )
    scale = {n: F.when(F.col(f"s_{n}") > 0, F.col(f"s_{n}")).otherwise(F.lit(1.0)) for n in names}
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.col(f"m_{n}").alias("mean"), scale[n].alias("scale"))
            for n in names
        ]
    )
    return wide.select(F.inline(rows))


def standardised(features: DataFrame, names: Sequence[str], stats: dict[str, tuple[float, float]]) -> list[Column]:
    """(x - mean) / scale for the named features."""
    return [
        ((F.col(n).cast("double") - F.lit(stats[n][0])) / F.lit(stats[n][1])).alias(n) for n in names
    ]


def require_both_classes(df: DataFrame) -> None:
    row = df.agg(
        F.count_if(F.col(TARGET) == 0).alias("q"), F.count_if(F.col(TARGET) == 1).alias("p")
    ).first()
    if not row["p"] or not row["q"]:
        raise ContractError("a fitting period must hold both classes")


def check_names(names: Sequence[str]) -> list[str]:
    """A model reads features of the pre-transaction columns and nothing else."""
    wrong = sorted(set(names) - set(FEATURES))
    if wrong or not names:
        raise ContractError(f"not features: {', '.join(wrong) or 'none named'}")
    return list(names)


def finite_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """The feature matrix of a fit or a score, in the pass that reads it: a value that is NULL,
    NaN or infinite fails the query and is named."""
    rows = add_features(df, keep=keep)
    checked = {
        n: F.when(is_finite(F.col(n)), F.col(n)).otherwise(F.raise_error(F.lit(f"feature {n} is not finite")).cast("float"))
        for n in FEATURES
    }
    return rows.select(*keep, *[c.alias(n) for n, c in checked.items()])


def _assembled(df: DataFrame, names: Sequence[str], *more: Column | str) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(names), outputCol="features")
    return assembler.transform(df).select("features", *more)


@dataclass(frozen=True)
class FitRows:
    """Rows of a fitting period for any number of fits: label, kept columns and checked features, and
    the features' means and deviations."""

    rows: DataFrame
    stats: dict[str, tuple[float, float]]


def fit_rows(train: DataFrame, keep: Sequence[str] = (), names: Sequence[str] = tuple(FEATURES)) -> FitRows:
    """Raw transaction rows to a narrow table, written once. Every fit reads its rows several times; deriving
    the features anew in each of these scans costs far more than the steps of the optimiser."""
    rows = checkpointed(finite_features(train, [TARGET, *keep]))
    return FitRows(rows, statistics_of(rows, names))


def fit_logistic(
    train: DataFrame | FitRows,
    weight: Column | None = None,
    alpha: float = 1e-4,
    epochs: int = 3,
    names: Sequence[str] = tuple(FEATURES),
    stats: dict[str, tuple[float, float]] | None = None,
) -> LinearModel:
    """L2 logistic regression on standardised features of raw transaction rows, or of rows
    that were prepared for several fits; ``weight`` reads the columns that these keep."""
    names = check_names(names)
    weight = F.lit(1.0) if weight is None else weight
    if isinstance(train, FitRows):
        require_both_classes(train.rows)
        made, weighted = train, train.rows.withColumn("_w", weight)
    else:
        require_both_classes(train)
        made = fit_rows(train.withColumn("_w", weight), ["_w"], names)
        weighted = made.rows
    stats = made.stats if stats is None else stats
    scaled = weighted.select(TARGET, "_w", *standardised(weighted, names, stats))
    fitted = LogisticRegression(
        labelCol=TARGET,
        weightCol="_w",
        regParam=float(alpha),
        elasticNetParam=0.0,
        maxIter=ITERATIONS_PER_EPOCH * int(epochs),
        standardization=False,
    ).fit(_assembled(scaled, names, TARGET, "_w"))
    return LinearModel(
        names,
        [stats[n][0] for n in names],
        [stats[n][1] for n in names],
        [float(w) for w in fitted.coefficients],
        float(fitted.intercept),
    )


def optimality(model: LinearModel, train: DataFrame | FitRows, weight: Column | None = None, alpha: float = 1e-4) -> DataFrame:
    """a certificate of a fit, from one aggregate over the rows it was fitted on.

    At the minimum of mean weighted log loss plus ``alpha``/2 of the squared coefficients the gradient is
    zero. One row: rows, frauds, weight, ``residual`` (its largest component here) and
    ``start`` (the same for the model that knows only the base rate). Nothing is refitted.
    """
    weight = F.lit(1.0) if weight is None else weight
    if isinstance(train, FitRows):
        rows = train.rows.withColumn("_w", weight)
    else:
        rows = finite_features(train.withColumn("_w", weight), [TARGET, "_w"])
    z = {n: (F.col(n).cast("double") - F.lit(m)) / F.lit(s) for n, m, s in zip(model.features, model.means, model.scales)}
    w, y = F.col("_w"), F.col(TARGET)
    sums = rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(y == 1).alias("fraud_count"),
        F.sum(w).alias("weight"),
        F.sum(w * y).alias("_wy"),
        F.sum(w * (model.score() - y)).alias("_g"),
        *[F.sum(w * (model.score() - y) * c).alias(f"_g_{n}") for n, c in z.items()],
        *[F.sum(w * y * c).alias(f"_y_{n}") for n, c in z.items()],
        *[F.sum(w * c).alias(f"_x_{n}") for n, c in z.items()],
    )
    total, base = F.col("weight"), F.col("_wy") / F.col("weight")
    here = [F.abs(F.col("_g") / total)] + [F.abs(F.col(f"_g_{n}") / total + F.lit(alpha * b)) for n, b in zip(model.features, model.weights)]
    start = [F.abs((base * F.col(f"_x_{n}") - F.col(f"_y_{n}")) / total) for n in model.features]
    return sums.select("row_count", "fraud_count", "weight", F.greatest(*here).alias("residual"), F.greatest(*start).alias("start"))


def recorded_model(model: LinearModel, scored: DataFrame, threshold: float) -> DataFrame:
    """a model and what it gave, as one long table (section, name, value): coefficients, scaler,
    metrics at the threshold and the confusion matrix of (label, score, amount) rows."""
    parts = {"mean": model.means, "scale": model.scales, "weight": model.weights}
    rows = [(s, n, float(v)) for s, values in parts.items() for n, v in zip(model.features, values)]
    rows.append(("weight", "intercept", model.intercept))
    spark = scored.sparkSession
    return spark.createDataFrame(rows, RECORD_SCHEMA).unionByName(recorded_metrics(scored, threshold))


def recorded_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """The metrics and the confusion matrix of a record."""
    one = scored.withColumn("_one", F.lit(0))
    metrics = compared_metrics(one, threshold, "_one").select(F.lit("metric").alias("section"), F.col("metric").alias("name"), "value")
    counts = ["true_positive", "false_positive", "false_negative", "true_negative"]
    matrix = threshold_metrics(one, [threshold], by=["_one"]).select(*[F.col(c).cast("double").alias(c) for c in counts])
    matrix = matrix.unpivot([], counts, "name", "value").select(F.lit("matrix").alias("section"), "name", "value")
    return metrics.unionByName(matrix)


def model_of(record: DataFrame) -> LinearModel:
    """The model of a record: some fifty numbers."""
    found: dict[str, dict[str, float]] = {"mean": {}, "scale": {}, "weight": {}}
    for r in record.where(F.col("section").isin(*found)).collect():
        found[r["section"]][r["name"]] = r["value"]
    names = [n for n in FEATURES if n in found["mean"]]
    weights = found["weight"]
    return LinearModel(names, *[[found[s][n] for n in names] for s in ("mean", "scale", "weight")], weights["intercept"])


def promotion_check(record: DataFrame, refit_scored: DataFrame, threshold: float) -> DataFrame:
    """a refit's metrics against the recorded ones: (section, metric, actual, expected,
    absolute_difference, matches). Ranking metrics may differ by 1e-6, those at the threshold
    by 1e-5, counts of the matrix not at all; a metric that is missing on a side differs."""
    limits = {"average_precision": 1e-6, "roc_auc": 1e-6}
    actual, expected = recorded_metrics(refit_scored, threshold), record.where("section IN ('metric', 'matrix')")
    both = actual.withColumnRenamed("value", "actual").join(expected.withColumnRenamed("value", "expected"), ["section", "name"], "full")
    limit = F.lit(1e-5)
    for name, value in limits.items():
        limit = F.when(F.col("name") == name, value).otherwise(limit)
    limit = F.when(F.col("section") == "matrix", 0.0).otherwise(limit)
    apart = F.abs(F.col("actual") - F.col("expected"))
    return both.select("section", F.col("name").alias("metric"), "actual", "expected", apart.alias("absolute_difference"), F.coalesce(apart <= limit, F.lit(False)).alias("matches"))


def statistics_of(features: DataFrame, names: Sequence[str] = tuple(FEATURES)) -> dict[str, tuple[float, float]]:
    """F1 as literals (17 pairs)."""
    rows = scaler_statistics(features, names).collect()
    if any(r["mean"] is None for r in rows):
        raise ContractError("the fitting period is empty")
    return {r["feature"]: (r["mean"], r["scale"]) for r in rows}


def prior_score(train: DataFrame) -> Column:
    """the fraud rate of the training rows, for every row."""
    return F.lit(float(train.agg(F.avg(F.col(TARGET).cast("double"))).first()[0] or 0.0))


def score_candidates(df: DataFrame, candidates: dict[str, Column], id_col: str = "txn_id") -> DataFrame:
    """Raw rows to (candidate, id, label, amount, score), features computed once per row."""
    rows = finite_features(df, [id_col, TARGET, "amount"])
    scores = F.array(
        *[
            F.struct(F.lit(name).alias("candidate"), score.alias("score"))
            for name, score in candidates.items()
        ]
    )
    return rows.select(
        F.col(id_col).alias("id"), F.col(TARGET).alias("label"), "amount", F.inline(scores)
    )


def fit_trees(
    train: DataFrame,
    params: dict,
    rounds: int,
    weight: str | None = "weight",
    validation: DataFrame | None = None,
    names: Sequence[str] = tuple(FEATURES),
    seed: int = 42,
):
    """gradient-boosted trees; with ``validation`` rows boosting stops when they stop improving.

    Spark ML has no L1/L2 leaf penalty; a setting that names one is refused.
    """
    unknown = set(params) - set(TREE_SPACE)
    if unknown:
        raise ContractError(f"no such tree settings: {sorted(unknown)}")
    check_names(names)
    require_both_classes(train)

    def prepared(df: DataFrame, held_out: bool) -> DataFrame:
        w = F.col(weight) if weight and weight in df.columns else F.lit(1.0)
        return finite_features(df.withColumns({"_w": w, "_held_out": F.lit(held_out)}), [TARGET, "_w", "_held_out"])

    rows = prepared(train, False)
    if validation is not None:
        rows = rows.unionByName(prepared(validation, True))
    data = _assembled(rows, names, TARGET, "_w", "_held_out").withColumn(
        TARGET, F.col(TARGET).cast("double")
    )
    trees = GBTClassifier(
        labelCol=TARGET,
        weightCol="_w",
        maxIter=int(rounds),
        maxDepth=int(params["max_depth"]),
        stepSize=float(params["learning_rate"]),
        subsamplingRate=float(params.get("subsample", 1.0)),
        minInstancesPerNode=max(1, int(params.get("min_child_weight", 1))),
        featureSubsetStrategy=_subset(params.get("colsample_bytree", 1.0)),
        seed=seed,
    )
    if validation is not None:
        trees = trees.setValidationIndicatorCol("_held_out")
    return trees.fit(data)


def _subset(share: float) -> str:
    return "all" if share >= 1.0 else str(float(share))


def score_model(model, df: DataFrame, candidate: str, names: Sequence[str] = tuple(FEATURES), id_col: str = "txn_id") -> DataFrame:
    """F8 for tree models: positive-class probability."""
    rows = finite_features(df, [id_col, TARGET, "amount"])
    data = _assembled(rows, names, id_col, TARGET, "amount")
    return model.transform(data).select(
        F.col(id_col).alias("id"),
        F.col(TARGET).alias("label"),
        "amount",
        F.lit(candidate).alias("candidate"),
        vector_to_array("probability")[1].alias("score"),
    )


def fit_shallow_tree(train: DataFrame, depth: int = 3, names: Sequence[str] = tuple(FEATURES), seed: int = 42):
    """an unweighted decision tree, to see which few features would do."""
    require_both_classes(train)
    rows = _assembled(finite_features(train, [TARGET]), check_names(names), TARGET)
    return DecisionTreeClassifier(labelCol=TARGET, maxDepth=depth, seed=seed).fit(rows)


def used_features(model, names: Sequence[str] = tuple(FEATURES)) -> list[str]:
    """features the tree splits on, in feature order."""
    return [n for n, v in zip(names, model.featureImportances.toArray(), strict=True) if v > 0]


def tree_rules(model, names: Sequence[str] = tuple(FEATURES)) -> str:
    """the tree as text with feature names."""
    text = model.toDebugString
    for i, n in sorted(enumerate(names), reverse=True):
        text = text.replace(f"feature {i} ", f"{n} ")
    return text


def spread(space: dict, limit: int, offset: int = 0) -> list[dict]:
    """``limit`` different settings of a grid, spread evenly over it.

    Settings are numbered in the order of the grid and visited in strides of about the golden
    ratio of their number. The stride shares no factor with the number, so no setting comes twice
    and any first few are far apart.
    """
    names = list(space)
    sizes = [len(space[n]) for n in names]
    total = math.prod(sizes)
    stride = next(k for k in itertools.count(max(1, round(total * GOLDEN))) if math.gcd(k, total) == 1)
    chosen = []
    for i in range(min(limit, total)):
        at, setting = (offset + i * stride) % total, {}
        for name, size in zip(names, sizes, strict=True):
            at, digit = divmod(at, size)
            setting[name] = space[name][digit]
        chosen.append(setting)
    return chosen


def logistic_trials(space: dict = LOGISTIC_SPACE, limit: int = 12) -> list[dict]:
    """settings spread over the logistic grid, each named after its values."""
    return [
        {
            "trial_id": f"logistic a={s['alpha_values']:g} e={s['epoch_values']} w={s['positive_class_weights']:g}",
            "alpha": float(s["alpha_values"]),
            "epochs": int(s["epoch_values"]),
            "positive_class_weight": float(s["positive_class_weights"]),
        }
        for s in spread(space, limit)
    ]


def tree_trials(space: dict = TREE_SPACE, seed: int = 42, limit: int = 8) -> list[dict]:
    """settings spread over the tree grid from a place that ``seed`` chooses."""
    return [
        {"trial_id": "trees " + "/".join(f"{v:g}" for v in s.values()), "parameters": s}
        for s in spread(space, limit, offset=seed)
    ]


def logistic_search(
    fit: DataFrame, tuning: DataFrame, trials: Sequence[dict], id_col: str = "txn_id"
) -> tuple[DataFrame, dict[str, LinearModel]]:
    """fit every trial, then score and evaluate all of them in one pass over the tuning rows."""
    require_both_classes(fit)
    rows = fit_rows(fit)
    fitted = {
        t["trial_id"]: fit_logistic(
            rows, positive_weight(t["positive_class_weight"]), t["alpha"], t["epochs"]
        )
        for t in trials
    }
    scored = score_candidates(tuning, {k: m.score() for k, m in fitted.items()}, id_col)
    scored = checkpointed(scored)
    settings = fit.sparkSession.createDataFrame(
        [(t["trial_id"], t["positive_class_weight"], float(t["epochs"])) for t in trials],
        "candidate string, cost_1 double, cost_2 double",
    )
    return evaluation_bundle(scored).join(F.broadcast(settings), "candidate"), fitted


def tree_search(
    fit: DataFrame,
    tuning: DataFrame,
    trials: Sequence[dict],
    max_negatives: int = 500_000,
    max_rounds: int | None = None,
    id_col: str = "txn_id",
) -> tuple[DataFrame, dict[str, object]]:
    """fit every trial on the weighted sample with early stopping, evaluate all at once."""
    require_both_classes(fit)
    # Drawn and hashed once, then read by every trial.
    sample = checkpointed(weighted_sample(fit, max_negatives, id_col=id_col))
    fitted, costs, scored = {}, [], None
    for t in trials:
        p = t["parameters"]
        rounds = min(p["n_estimators"], max_rounds or p["n_estimators"])
        model = fit_trees(sample, p, rounds, validation=tuning)
        fitted[t["trial_id"]] = model
        costs.append((t["trial_id"], float(model.getNumTrees), float(p["max_depth"])))
        part = score_model(model, tuning, t["trial_id"], id_col=id_col)
        scored = part if scored is None else scored.unionByName(part)
    settings = fit.sparkSession.createDataFrame(
        costs, "candidate string, cost_1 double, cost_2 double"
    )
    scored = checkpointed(scored)
    return evaluation_bundle(scored).join(F.broadcast(settings), "candidate"), fitted


def rank_trials(bundle: DataFrame) -> DataFrame:
    """best trial by AP, F2, lower alert rate, then lower costs (weight and epochs, or trees
    and depth)."""
    key = F.struct(
        F.col("average_precision"),
        F.col("selected_f_beta"),
        -F.col("selected_alert_rate"),
        -F.col("cost_1"),
        -F.col("cost_2"),
    )
    return bundle.agg(F.max_by("candidate", key).alias("best_trial"))


def baseline_champion(
    bundle: DataFrame, prior: str = "prior_probability", simplest: str = "unweighted_logistic"
) -> DataFrame:
    """AP, F2, lower alert rate, simplicity; the prior drops out once a learned model beats it."""
    name, ap = F.col("candidate"), F.col("average_precision")
    best_learned = bundle.where(name != prior).agg(F.max("average_precision")).scalar()
    eligible = bundle.where((name != prior) | (ap >= best_learned))
    key = F.struct(ap, F.col("selected_f_beta"), -F.col("selected_alert_rate"), (name == simplest).cast("int"))
    return eligible.agg(
        F.max_by("candidate", key).alias("champion"),
        F.bool_or(name == prior).alias("prior_eligible"),
    )


def challenger_champion(
    bundle: DataFrame, baseline: str, simplest: str, tolerance: float = MINIMUM_IMPROVEMENT
) -> DataFrame:
    """the best learned candidate, unless it beats the baseline's AP by less than ``tolerance``."""
    name, ap = F.col("candidate"), F.col("average_precision")
    key = F.struct(
        ap,
        F.col("selected_f_beta"),
        F.col("top_0_5_fraud_amount_recall"),
        -F.col("selected_alert_rate"),
        (name == simplest).cast("int"),
    )
    learned = name != baseline
    wide = bundle.agg(
        F.max_by(F.when(learned, name), F.when(learned, key)).alias("best"),
        (
            F.max_by(F.when(learned, ap), F.when(learned, key)) - F.max(F.when(~learned, ap))
        ).alias("improvement"),
    )
    return wide.select(
        F.when(F.col("improvement") >= tolerance, F.col("best")).otherwise(F.lit(baseline)).alias("champion"),
        "improvement",
    )


def ablation(
    fit: DataFrame, tuning: DataFrame, params: dict, rounds: int, max_negatives: int = 500_000,
    id_col: str = "txn_id",
) -> DataFrame:
    """F16: refit the trees on each feature group and report seven metrics per group."""
    require_both_classes(fit)
    # Drawn and hashed once, then read by every group.
    sample = checkpointed(weighted_sample(fit, max_negatives, id_col=id_col))
    scored = None
    for group, names in FEATURE_GROUPS.items():
        model = fit_trees(sample, params, rounds, names=names)
        part = score_model(model, tuning, group, names, id_col)
        scored = part if scored is None else scored.unionByName(part)
    return evaluation_bundle(checkpointed(scored)).select(
        F.col("candidate").alias("feature_group"),
        "average_precision",
        "roc_auc",
        F.col("selected_precision").alias("best_f2_precision"),
        F.col("selected_recall").alias("best_f2_recall"),
        F.col("selected_f_beta").alias("best_f2_score"),
        F.col("selected_alert_rate").alias("alert_rate"),
        F.col("top_0_1_recall").alias("top_0_1_percent_recall"),
    )


def permutation_test(
    fit: DataFrame, tuning: DataFrame, max_negatives: int = 10_000, rounds: int = 50,
    id_col: str = "txn_id",
) -> DataFrame:
    """trees fitted on shuffled labels must rank the tuning rows no better than chance.

    ``max_negatives`` bounds the rows of the fit; all tuning rows are evaluated.
    """
    require_both_classes(fit)
    # Drawn and hashed once, shuffled once, then read by every step of the fit.
    sample = checkpointed(weighted_sample(fit, max_negatives, id_col=id_col))
    shuffled = checkpointed(permuted_labels(sample, id_col=id_col))
    model = fit_trees(shuffled, {"max_depth": 3, "learning_rate": 0.1}, rounds)
    scored = checkpointed(score_model(model, tuning, "permuted", id_col=id_col))
    bundle = evaluation_bundle(scored)
    return bundle.select(
        F.col("row_count").alias("evaluation_rows"),
        F.col("fraud_count").alias("evaluation_fraud_count"),
        (F.col("fraud_count") / F.col("row_count")).alias("fraud_prevalence"),
        "average_precision",
        "roc_auc",
    )
