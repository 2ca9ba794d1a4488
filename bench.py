"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``python bench.py --refit`` also times the production refit with its validation check on the
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from tollgate.plans import catalog  # noqa: E402
from tollgate.session import checkpointed, local_session  # noqa: E402

HEADLINE = [
    "split_fraud_rates",
    "b6_quality_report",
    "b10_fingerprint",
    "c1_features",
    "d5_split_summary",
    "d9_weighted_sample",
    "e2_fraud_by_type",
    "e4_amount_statistics",
    "e12_balance_ratio",
    "f8_frozen_scores",
    "g1_threshold_metrics",
    "g5_average_precision",
    "g8_best_thresholds",
    "g9_topk_review",
    "g10_score_summary",
    "g16_evaluation_bundle",
    "h2_duplicates_exact",
    "h4_rule_performance",
    "i2_intake",
    "i5_audit_records",
    "i7_outcome_merge",
    "j1_reference_profile",
    "j14_monitoring_metrics",
    "k5_minute_totals",
    "k6_trailing_windows",
    "l2_error_rate",
    "l3_latency_quantiles",
    "l9_sustained_alerts",
]


def timed(df_of) -> float:
    start = time.perf_counter()
    df_of().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def refit(spark, sf_dir: str, rows_wanted: int = 5_400_000) -> dict[str, float]:
    """Scaling, weighted logistic fit and validation metrics over repeated transactions."""
    from tollgate.operators import chrono, evaluate, models
    from tollgate.operators.sampling import positive_weight
    from tollgate.sources import canonical

    base = canonical.transactions(spark, sf_dir)
    count = base.count()
    times = max(1, round(rows_wanted / count))
    rows = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    rows = rows.withColumn("txn_id", F.col("txn_id") * times + F.col("copy")).drop("copy")
    wanted = ["txn_id", "step", "type", "amount", "oldbalanceOrg", "oldbalanceDest", "isFraud"]
    stored = checkpointed(rows.select(*wanted).repartition(32))
    start = time.perf_counter()
    bounds = chrono.choose_boundaries(stored)
    split = bounds.split(F.col("step"))
    train, validation = stored.where(split == "train"), stored.where(split == "validation")
    model = models.fit_logistic(train, positive_weight(5.0), alpha=1e-5, epochs=3)
    fitted = time.perf_counter() - start
    scored = checkpointed(models.score_candidates(validation, {"production": model.score()}))
    evaluate.evaluation_bundle(scored).collect()
    return {"rows": count * times, "fit_sec": fitted, "total_sec": time.perf_counter() - start}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", memory="16g")
    took: dict[str, float] = {}
    for name in HEADLINE:
        # The first run compiles the query's stages; the second is the one that counts.
        first = timed(lambda: catalog.QUERIES[name](spark, sf_dir))
        second = timed(lambda: catalog.QUERIES[name](spark, sf_dir))
        took[name] = round(min(first, second), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
    }
    if "--refit" in sys.argv:
        line["refit"] = {k: round(v, 3) for k, v in refit(spark, sf_dir).items()}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
