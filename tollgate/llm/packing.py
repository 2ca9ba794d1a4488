"""Sharding by vector bin packing: bytes, tokens and rows of groups of equal texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm.mixing import word_count
from tollgate.llm.registry import query, table
from tollgate.session import checkpointed

SHARDS = 8
#: Small groups are placed in so many bundles by hash; a group that holds more than that share
#: of all bytes is placed by itself. Part of the law: a group of up to the share WHOLE of a shard stays whole,
#: a larger one is cut into slices of about 1/BUNDLES of all bytes, so that shards come out near equal.
BUNDLES = 4096
WHOLE = 0.05
#: Rows meant for one range of slots.
SLOT_ROWS = 4_000


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (a row of bytes, tokens, rows): large items first, each to the shard
    where the dot product of its needs with the capacity left is highest, among those it fits."""
    total = items.sum(axis=0)
    needs = items / np.where(total > 0, total, 1) * shards
    left, placed = np.ones((shards, items.shape[1])), np.zeros(len(items), np.int64)
    for i in sorted(range(len(items)), key=lambda i: (-needs[i].max(), i)):
        fits = (left >= needs[i]).all(axis=1)
        # where nothing fits, every shard is open
        score = np.where(fits | ~fits.any(), left @ needs[i], -np.inf)
        placed[i] = int(score.argmax())
        left[placed[i]] -= needs[i]
    return placed


def sharded(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES, whole_share: float = WHOLE) -> DataFrame:
    """One row per row of (doc_id, text): (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The law is ``bytes``. Equal texts stay in one shard unless they hold more than ``whole_share`` of
    a shard; then they are cut by hash of id and row into slices. A null text counts as an empty
    one (1 byte, crc 0, equal to the empty text); null and repeated ids are ordinary; an empty
    table gives no rows. The driver places at most about 3 ``bundles`` items, whatever the size.
    """
    text = F.coalesce("text", F.lit(""))
    rows = checkpointed(
        docs.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            word_count(F.col("text")).alias("tokens"),
            F.xxhash64(text).alias("mixed"),
        )
    )
    key = ["mixed", "size", "text_crc32"]
    total = rows.agg(F.sum("size")).first()[0] or 0
    most, whole = total / bundles, total / shards * whole_share
    # fewer than ``bundles`` groups can be above the mean of so many
    large = rows.groupBy(*key).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most)
    large = checkpointed(large.select(*key, F.when(F.col("bytes") <= whole, 1).otherwise(F.ceil(F.col("bytes") / max(most, 1))).alias("slices")))
    spot = F.when(F.col("slices").isNull(), F.pmod("mixed", F.lit(bundles))).otherwise(F.pmod(F.xxhash64("doc_id", "row"), "slices"))
    rows = rows.join(F.broadcast(large), key, "left").withColumn("own", F.when(F.col("slices").isNotNull(), F.col("mixed"))).withColumn("spot", spot)
    items = rows.groupBy("own", "spot").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).collect()
    items.sort(key=lambda x: (x.own is not None, x.own or 0, x.spot))
    placed = pack(np.array([[x.b, x.t, x.r] for x in items], dtype=np.float64).reshape(-1, 3), shards)
    spark = docs.sparkSession
    where = spark.createDataFrame([(x.own, x.spot, int(p)) for x, p in zip(items, placed)], "own2 long, spot2 long, shard int")
    rows = rows.join(F.broadcast(where), F.col("own").eqNullSafe(F.col("own2")) & (F.col("spot") == F.col("spot2")))
    # slots: ranges of a shard's rows by hash, numbered apart and shifted by the rows before
    ranges = max(1, -(-sum(x.r for x in items) // (shards * SLOT_ROWS)))
    rows = rows.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(ranges)).alias("part"))
    counts = rows.groupBy("shard", "part").count()
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("shard").alias("shard2"), F.col("part").alias("part2"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"))
    rows = rows.join(shift, (F.col("shard") == F.col("shard2")) & (F.col("part") == F.col("part2")))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("shift") + nth - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


@query("op6_vector_bin_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
