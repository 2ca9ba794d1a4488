"""The idempotent prediction ledger as relational operators.

Keys are never trusted to be small: everything per request, prediction or batch is folded
with combinable aggregates, and facts return to the rows through ``keyed.attach``.
"""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.exprs import text_lanes
from tollgate.operators.keyed import attach
from tollgate.operators.ordered import assign_slab, cut_points
from tollgate.session import checkpointed

# Fixed value: most items a request may carry.
MAX_BATCH = 1000
# Contradicting label rows that one task walks in order.
SLAB_ROWS = 200_000


def payload_hash(endpoint: Column, transactions: Column) -> Column:
    """SHA-256 of endpoint and ordered transactions, for requests that carry an array."""
    body = F.struct(endpoint.alias("endpoint"), transactions.alias("transactions"))
    return F.sha2(F.to_json(body), 256)


def payload_hashes(items: DataFrame, endpoints: DataFrame) -> DataFrame:
    """I1 for exploded requests: a hash per request that needs no list of its items.

    Each item's text holds its index, so summing the md5 lanes of the items keeps their
    order and still combines map-side for a request of any size.
    """
    lanes = text_lanes(
        "item_index",
        "step",
        "transaction_type",
        "amount",
        "oldbalance_origin",
        "oldbalance_destination",
    )
    folded = items.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(lane).alias(f"lane{i}") for i, lane in enumerate(lanes)],
    )
    text = F.concat_ws("#", "endpoint", "n", *[f"lane{i}" for i in range(len(lanes))])
    return folded.join(endpoints.select("request_id", "endpoint"), "request_id").select(
        "request_id", F.sha2(text, 256).alias("payload_hash")
    )


def first_attempts(attempts: DataFrame, order: str, payload: str) -> DataFrame:
    """The first delivery of each request and how many deliveries there were."""
    return attempts.groupBy("request_id").agg(
        F.min(F.struct(F.col(order).alias("o"), F.col(payload).alias("p"))).alias("_first"),
        F.count(F.lit(1)).alias("_deliveries"),
    )


def classify_attempts(
    attempts: DataFrame,
    order: str = "attempt",
    payload: str = "payload_hash",
    stored: DataFrame | None = None,
) -> DataFrame:
    """New, replay (same payload as the first delivery) or conflict.

    ``stored`` (request_id and payload) holds requests that were taken in before; they win over
    any delivery among ``attempts``.
    """
    facts = first_attempts(attempts, order, payload)
    known = F.lit(False)
    if stored is not None:
        before = stored.select("request_id", F.col(payload).alias("_before"))
        facts = facts.join(before, "request_id", "left").withColumn(
            "_first", F.struct("_first.o", F.coalesce("_before", "_first.p").alias("p"),
                               F.col("_before").isNotNull().alias("known"))
        ).drop("_before")
        known = F.col("_first.known")
    joined = attach(attempts, facts, "request_id", "_deliveries")
    status = (
        F.when(F.col(payload) != F.col("_first.p"), "conflict")
        .when(~known & (F.col(order) == F.col("_first.o")), "new")
        .otherwise("replay")
    )
    return joined.withColumn("status", status).drop("_first")


def materialise_events(requests: DataFrame, score: Column, level: Column) -> DataFrame:
    """One event per item of each request's ``transactions`` array, in item order.

    ``score`` and ``level`` read the item's columns and ``fraud_score``. Items stay in the row
    of their request until here, so nothing shuffles.
    """
    items = requests.select(
        "request_id",
        "created_at",
        F.posexplode("transactions").alias("item_index", "item"),
    ).select("request_id", "created_at", "item_index", "item.*")
    return (
        items.withColumn("fraud_score", score)
        .withColumn("risk_level", level)
        .withColumn("prediction_id", F.sha2(F.concat_ws(":", "request_id", "item_index"), 256))
    )


def stored_results(requests: DataFrame, events: DataFrame) -> DataFrame:
    """I4: stored predictions of complete requests, one row per item, of any number of items.

    A request is complete if its events are exactly items 0 .. batch_size - 1; the others are
    in B11's report.
    """
    items = events.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.min("item_index").alias("first_item"),
        F.max("item_index").alias("last_item"),
    )
    size = F.col("batch_size")
    whole = (
        requests.join(items, "request_id")
        .where(
            (F.col("items") == size)
            & (F.col("first_item") == 0)
            & (F.col("last_item") == size - 1)
        )
        .select("request_id")
    )
    fields = ["item_index", "prediction_id", "fraud_score", "prediction", "risk_level"]
    return events.join(whole, "request_id", "left_semi").select("request_id", *fields)


def audit_records(events: DataFrame, requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Event with its request (must exist) and its outcome (if any)."""
    asked = requests.select(
        "request_id",
        F.col("created_at").alias("request_created_at"),
        *[c for c in requests.columns if c not in ("request_id", "created_at")],
    )
    return events.join(asked, "request_id").join(outcomes, "prediction_id", "left")


def admit_batches(
    submissions: DataFrame, events: DataFrame, stored: DataFrame, max_submissions: int = MAX_BATCH
) -> DataFrame:
    """One row per label batch with its faults; a batch with any fault is refused whole.

    Batches come in the order of their first position. Each is judged on its own, against the
    stored labels, and against the batches of this call that were admitted before it; a refused
    batch leaves no trace. Faults: ids that do not exist (``unknown_ids``), labels that differ from
    the batch's first one for the same id (``label_conflicts``), from the stored one
    (``stored_conflicts``), from one admitted earlier in this call (``earlier_conflicts``, counted
    for batches without another fault), and more than ``max_submissions`` rows (``oversize``).
    ``submissions`` has batch_id, position, prediction_id, actual_fraud (0 or 1); positions are
    unique.
    """
    label = F.col("actual_fraud")
    pairs = submissions.groupBy("batch_id", "prediction_id").agg(
        F.min(F.struct("position", "actual_fraud")).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(label == 1).alias("_ones"),
    )

    def differing(other: Column) -> Column:
        """Rows of a pair whose label is not ``other``; none where that is NULL."""
        return F.coalesce(F.when(other == 1, F.col("_n") - F.col("_ones")).when(other == 0, F.col("_ones")), F.lit(0))

    # A prediction in very many batches makes one large partition, which AQE splits.
    known = events.select("prediction_id", F.lit(True).alias("_known"))
    had = stored.select("prediction_id", F.col("actual_fraud").alias("_stored"))
    judged = pairs.join(known, "prediction_id", "left").join(had, "prediction_id", "left")
    judged = checkpointed(
        judged.select(
            "batch_id",
            "prediction_id",
            "_n",
            F.col("_first.actual_fraud").alias("_label"),
            F.col("_first.position").alias("_at"),
            F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0).alias("_unknown"),
            differing(F.col("_first.actual_fraud")).alias("_own"),
            differing(F.col("_stored")).alias("_other"),
        )
    )
    faults = (
        judged.groupBy("batch_id")
        .agg(
            F.sum("_n").alias("submissions"),
            F.sum("_unknown").alias("unknown_ids"),
            F.sum("_own").alias("label_conflicts"),
            F.sum("_other").alias("stored_conflicts"),
            F.min("_at").alias("_order"),
        )
        .withColumn("oversize", F.col("submissions") > max_submissions)
    )
    sound = faults.where(
        "unknown_ids = 0 AND label_conflicts = 0 AND stored_conflicts = 0 AND NOT oversize"
    ).select("batch_id", "_order")
    late = _later_clashes(judged.select("batch_id", "prediction_id", "_n", "_label").join(sound, "batch_id"))
    verdict = faults.join(late, "batch_id", "left").withColumn(
        "earlier_conflicts", F.coalesce("earlier_conflicts", F.lit(0))
    )
    return verdict.select(
        "batch_id", "submissions", "unknown_ids", "label_conflicts", "stored_conflicts",
        "earlier_conflicts", "oversize",
        (
            (F.col("unknown_ids") == 0)
            & (F.col("label_conflicts") == 0)
            & (F.col("stored_conflicts") == 0)
            & (F.col("earlier_conflicts") == 0)
            & ~F.col("oversize")
        ).alias("admitted"),
    )


def _later_clashes(pairs: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Rows per sound batch (batch_id, earlier_conflicts) that differ from a label admitted before.

    Only ids that have both labels matter; their rows are walked in the order of their batches. A
    task walks a slab of consecutive batches and hands the labels that it admitted to the next
    slab. So the number of jobs depends on the number of contradicting rows, of which
    a slab holds ``slab_rows``, never on how batches hang together. No pair of batches is ever formed.
    """
    torn = (
        pairs.groupBy("prediction_id")
        .agg(F.min("_label").alias("lo"), F.max("_label").alias("hi"))
        .where("lo <> hi")
        .select("prediction_id")
    )
    rows = checkpointed(
        pairs.join(torn, "prediction_id", "left_semi").select(
            "batch_id", "prediction_id", "_n", "_label", "_order"
        )
    )
    slabs = -(-rows.count() // slab_rows)
    cuts = cut_points(rows, "_order", slabs) if slabs > 1 else []
    rows = assign_slab(rows, "_order", cuts)
    batch = rows.schema["batch_id"].dataType.simpleString()
    key = rows.schema["prediction_id"].dataType.simpleString()
    walked = None
    for slab in range(len(cuts) + 1):
        here = rows.where(F.col("_slab") == slab)
        if walked is not None:
            before = walked.where("admitted").groupBy("prediction_id").agg(F.first("_label").alias("_held"))
            here = here.join(before, "prediction_id", "left")
        else:
            here = here.withColumn("_held", F.lit(None).cast("int"))
        here = here.select(*[F.col(c) for c in ("_slab", "batch_id", "prediction_id", "_n", "_label", "_order", "_held")])
        made = here.groupBy("_slab").applyInPandas(
            _walk, f"batch_id {batch}, prediction_id {key}, _label int, earlier_conflicts bigint, admitted boolean"
        )
        if cuts:
            made = checkpointed(made)
        walked = made if walked is None else walked.unionByName(made)
    return walked.groupBy("batch_id").agg(F.max("earlier_conflicts").alias("earlier_conflicts"))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Batches in order: each is admitted unless it differs from a label admitted before."""
    held = rows.dropna(subset=["_held"])
    labels = dict(zip(held["prediction_id"], held["_held"].astype(int)))
    rows = rows.sort_values("_order", kind="stable").reset_index(drop=True)
    conflicts, admitted = [0] * len(rows), [True] * len(rows)
    ids, given, times = rows["prediction_id"].tolist(), rows["_label"].tolist(), rows["_n"].tolist()
    for _, at in rows.groupby("_order", sort=True).indices.items():
        clash = sum(times[k] for k in at if labels.get(ids[k], given[k]) != given[k])
        for k in at:
            conflicts[k], admitted[k] = clash, clash == 0
            if not clash:
                labels[ids[k]] = given[k]
    return rows[["batch_id", "prediction_id", "_label"]].assign(earlier_conflicts=conflicts, admitted=admitted)


def merge_outcomes(
    submissions: DataFrame, admissions: DataFrame, stored: DataFrame
) -> DataFrame:
    """The submissions of admitted batches, each flagged as replayed or not.

    Rows with ``replayed = false`` are the ones to insert: the first occurrence of a prediction
    that has no stored label, with its own source and time. An admitted batch has at most
    MAX_BATCH rows, so batch_id is no skewed key here.
    """
    accepted = submissions.join(
        checkpointed(admissions.where("admitted").select("batch_id")), "batch_id", "left_semi"
    )
    first = accepted.groupBy("prediction_id").agg(
        F.min("position").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    facts = first.join(
        stored.select("prediction_id", F.lit(True).alias("_stored")), "prediction_id", "left"
    )
    rows = accepted.join(facts, "prediction_id").drop("_n")
    replayed = F.coalesce("_stored", F.lit(False)) | (F.col("position") != F.col("_first"))
    return rows.withColumn("replayed", replayed).drop("_first", "_stored")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """I8: rows per table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        out = part if out is None else out.unionByName(part)
    return out


def lookup(events: DataFrame, ids: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Events whose id was asked for, each once however often it was asked for."""
    return events.join(ids.select(key).distinct(), key, "left_semi")


def time_literal(df: DataFrame, column: str, value: datetime) -> Column:
    """A UTC instant as a literal of the column's own timestamp type."""
    if value.tzinfo is None:
        raise ValueError("window bounds must be timezone-aware")
    text = value.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "+00:00").cast("timestamp")


def window_events(
    events: DataFrame, outcomes: DataFrame, start: datetime, end: datetime
) -> DataFrame:
    """Events created in [start, end) with their outcome if one has arrived.

    The range filter sits on the scan of the events; labels join with whatever delay.
    """
    created = F.col("created_at")
    inside = events.where(
        (created >= time_literal(events, "created_at", start))
        & (created < time_literal(events, "created_at", end))
    )
    labels = outcomes.select("prediction_id", "actual_fraud")
    return inside.join(labels, "prediction_id", "left")
