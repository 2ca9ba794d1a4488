"""Running totals, ranks and exact quantiles without a single-task sort.

A window without PARTITION BY sorts the whole table in one task. Here rows first
collapse to one row per distinct key (map-side combine takes care of hot keys), the
distinct keys are cut into slabs by approximate quantiles, each slab is summed in
order on its own, and the totals of the slabs before it are added. The cuts only
balance the work: any cuts give the same exact result. They are literals, so a slab is
a fixed function of the key and a recomputed task puts every row where it was before.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.session import checkpointed


# Hash classes of keys of which one decides the cut points.
CUT_SAMPLE = 64


def slab_count(df: DataFrame) -> int:
    """As many slabs as the session has shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, key: str, slabs: int | None = None) -> list[float]:
    """At most ``slabs - 1`` increasing values that split ``key`` about evenly.

    One narrow scan, no shuffle of rows. Only keys from one of CUT_SAMPLE hash classes feed
    the sketch: the choice is by key, so a key that a third of all rows share weighs no more
    than its class, and a poor choice could cost balance but never a row.
    """
    slabs = slabs or slab_count(df)
    points = [i / slabs for i in range(1, slabs)]
    accuracy = max(1000, 20 * slabs)
    chosen = F.pmod(F.xxhash64(key), F.lit(CUT_SAMPLE)) == 0
    row = (
        df.where(chosen)
        .agg(F.percentile_approx(F.col(key).cast("double"), points, accuracy).alias("cuts"))
        .first()
    )
    return sorted(set(row["cuts"] or []))


def assign_slab(df: DataFrame, key: str, cuts: Sequence[float]) -> DataFrame:
    """Add ``_slab``: how many cuts are <= key (a binary search in the JVM)."""
    if not cuts:
        return df.withColumn("_slab", F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=key, outputCol="_slab").transform(df)


def running_totals(
    df: DataFrame,
    key: str,
    sums: dict[str, Column],
    by: Sequence[str] = (),
    then_by: Sequence[str] = (),
    descending: bool = False,
    cuts: Sequence[float] | None = None,
    slab: Column | None = None,
) -> DataFrame:
    """One row per (by, key, then_by) with each sum, its running and its overall total.

    For a sum ``n`` the output has ``n`` (this key), ``n_upto`` (this key and all keys
    before it) and ``n_total``. ``by`` must be a handful of groups (candidates, periods), because
    a row per group and slab is broadcast. ``then_by`` breaks ties between rows of the same
    ``key``. Slabs come from ``cuts``, or from ``slab``, any non-decreasing function of the key,
    or else from a sketch of the key.
    """
    by, then_by = list(by), list(then_by)
    if slab is None and cuts is None:
        cuts = cut_points(df, key)
    cells = df.groupBy(*by, key, *then_by).agg(*[c.alias(n) for n, c in sums.items()])
    cells = assign_slab(cells, key, cuts) if slab is None else cells.withColumn("_slab", slab)
    cells = cells.withColumn("_slab", F.coalesce(F.col("_slab").cast("double"), F.lit(0.0)))

    def ordered(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    inside = (
        Window.partitionBy(*by, "_slab")
        .orderBy(ordered(key), *then_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # One row per slab and group, whatever the data size; slabs are as many as shuffle partitions.
    slabs = cells.groupBy(*by, "_slab").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    earlier = (
        Window.partitionBy(*by)
        .orderBy(ordered("_slab"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*by)
    slabs = slabs.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_slab").alias("_by_slab"),
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    # Null-safe equality keeps NULL groups, and it adds no IS NOT NULL filter to one side, which
    # would make the two sides read different shuffles.
    same = F.col("_slab").eqNullSafe(F.col("_by_slab"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return (
        cells.withColumns({f"{n}_upto": F.sum(n).over(inside) for n in sums})
        .join(F.broadcast(slabs), same, "left")
        .withColumns({f"{n}_upto": F.col(f"{n}_upto") + F.col(f"_{n}_before") for n in sums})
        .drop("_slab", "_by_slab", *[f"_by_{c}" for c in by], *[f"_{n}_before" for n in sums])
    )


def order_bits(value: Column) -> Column:
    """A double's 64 bits as a long that sorts like the double: NaN last, negative zero as zero.

    There is no cast for it, so they are put together from exponent and mantissa; all steps are
    multiplications by powers of two, which are exact.
    """
    x = F.abs(value)
    guess = F.floor(F.log2(x))
    # the logarithm may round across a power of two
    exponent = guess + F.when(x >= F.pow(F.lit(2.0), guess + 1), 1).when(x < F.pow(F.lit(2.0), guess), -1).otherwise(0)
    part = ((x / F.pow(F.lit(2.0), exponent) - 1) * 2.0**52).cast("bigint")
    normal = (exponent + 1023).cast("bigint") * (1 << 52) + part
    tiny = (x * 2.0**600 * 2.0**474).cast("bigint")
    size = F.when(x == 0, F.lit(0)).when(x < 2.0**-1022, tiny).when(x > 1.7976931348623157e308, F.lit(2047 << 52)).otherwise(normal)
    signed = F.when(value < 0, -size).otherwise(size)
    return F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(signed).cast("bigint")


def of_bits(bits: int) -> float:
    """The double of ``order_bits``."""
    if bits == 2**63 - 1:
        return float("nan")
    size = struct.unpack("<d", struct.pack("<q", abs(bits)))[0]
    return -size if bits < 0 else size


# Bits that are left open after each scan of a radix selection: sixteen are settled at a time.
_SHIFTS = (48, 32, 16, 0)


def select_ranks(
    rows: DataFrame, bits: Column, ranks: dict[tuple, list[int]], by: Sequence[str]
) -> dict[tuple, dict[int, tuple[int, int]]]:
    """Radix selection: per group and wanted place, counted from 0, the bits that stand there and the
    number of rows with smaller ones.

    The bits are written once, as a table of one narrow column. Every scan of it counts rows by their
    next sixteen bits, in the cells that hold a wanted place; counts are folded map-side, so no
    row is ever shuffled. At most four scans, fewer where a cell holds one value only. ``ranks`` has
    few groups and places; only they reach the driver.
    """
    by = list(by)
    spark = rows.sparkSession
    found: dict[tuple, dict[int, tuple[int, int]]] = {g: {} for g in ranks}
    rows = checkpointed(rows.select(*by, bits.alias("_bits")))
    kinds = [rows.schema[c] for c in by]
    # group, cell, rows of the group before the cell, place
    open_ = [(g, None, 0, r) for g, places in ranks.items() for r in sorted(set(places))]
    wider = None
    for shift in _SHIFTS:
        if not open_:
            break
        source = rows
        if wider is not None:
            cells = [T.StructField("_cell", T.LongType())]
            inside = spark.createDataFrame(sorted({(*g, c) for g, c, _, _ in open_}, key=str), T.StructType([*kinds, *cells]))
            inside = inside.select(*[F.col(c).alias(f"_in_{c}") for c in by], "_cell")
            same = F.shiftright("_bits", wider) == F.col("_cell")
            for c in by:
                same = same & F.col(c).eqNullSafe(F.col(f"_in_{c}"))
            source = rows.join(F.broadcast(inside), same, "left_semi")
        counts = source.groupBy(*by, F.shiftright("_bits", shift).alias("_at")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_bits").alias("_low"), F.max("_bits").alias("_high")
        )
        # cells of one step: at most 65 536 rows
        outer = F.shiftright("_at", wider - shift) if wider is not None else F.lit(0)
        counts = counts.withColumn("_outer", outer)
        running = Window.partitionBy(*by, "_outer").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_upto", F.sum("_n").over(running))
        places = spark.createDataFrame(
            [(*g, 0 if c is None else c, before, r) for g, c, before, r in open_],
            T.StructType([*kinds, *[T.StructField(n, T.LongType()) for n in ("_cell", "_before", "_place")]]),
        )
        places = places.select(*[F.col(c).alias(f"_in_{c}") for c in by], "_cell", "_before", "_place")
        holds = (F.col("_outer") == F.col("_cell")) & (F.col("_before") + F.col("_upto") > F.col("_place"))
        holds = holds & (F.col("_before") + F.col("_upto") - F.col("_n") <= F.col("_place"))
        for c in by:
            holds = holds & F.col(c).eqNullSafe(F.col(f"_in_{c}"))
        hits = counts.join(F.broadcast(places), holds).select(
            *by, "_at", (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_less"), "_place", "_low", "_high"
        )
        open_ = []
        for r in hits.collect():
            group = tuple(r[: len(by)])
            if r["_low"] == r["_high"]:
                found[group][r["_place"]] = (r["_low"], r["_less"])
            else:
                open_.append((group, r["_at"], r["_less"], r["_place"]))
        wider = shift
    return found


def exact_quantiles(df: DataFrame, key: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per group and one column per named quantile,
    and ``n``, the group's values; NULLs do not count. ``by`` must be a handful of groups.
    """
    by = list(by)
    rows = df.where(F.col(key).isNotNull())
    bits = order_bits(F.col(key).cast("double"))
    sizes = {tuple(r[: len(by)]): r["_n"] for r in rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).collect() if r["_n"]}
    places = {g: sorted({p for q in quantiles.values() for p in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}) for g, n in sizes.items()}
    found = select_ranks(rows, bits, places, by)
    out = []
    for group, n in sizes.items():
        values = []
        for q in quantiles.values():
            h = (n - 1) * q
            low, high = (of_bits(found[group][p][0]) for p in (math.floor(h), math.ceil(h)))
            values.append(low + (high - low) * (h - math.floor(h)) if high != low else low)
        out.append((*group, *values, n))
    fields = [df.schema[c] for c in by] + [T.StructField(q, T.DoubleType()) for q in quantiles] + [T.StructField("n", T.LongType())]
    return df.sparkSession.createDataFrame(out, T.StructType(fields))


def nth_smallest(df: DataFrame, n: int, key: str, id_col: str) -> tuple[int, object] | None:
    """The n-th smallest (key, id), or None if there are at most ``n`` rows; ``key`` is a whole
    number that is hardly ever shared by different ids, such as a hash.

    Only the ids of one key are ordered, and they are folded to one row each, so an id that repeats
    is no matter.
    """
    rows = df.select(F.col(key).cast("bigint").alias(key), id_col)
    if rows.count() <= n:
        return None
    found, at = select_ranks(rows, F.col(key), {(): [n - 1]}, [])[()][n - 1]
    for r in rows.where(F.col(key) == found).groupBy(id_col).count().orderBy(id_col).collect():
        at += r["count"]
        if at >= n:
            return (found, r[id_col])
    raise AssertionError("the rows changed between two scans")


def up_to(edge: tuple[int, object], key: str, id_col: str) -> Column:
    """Rows whose (key, id) is at most ``edge``."""
    k, i = F.lit(edge[0]), F.lit(edge[1])
    return (F.col(key) < k) | ((F.col(key) == k) & (F.col(id_col) <= i))


def smallest(df: DataFrame, n: int, key: str, id_col: str) -> DataFrame:
    """Rows with the ``n`` smallest (key, id): a plain filter once the n-th is known."""
    if n <= 0:
        return df.where(F.lit(False))
    edge = nth_smallest(df, n, key, id_col)
    return df if edge is None else df.where(up_to(edge, key, id_col))
