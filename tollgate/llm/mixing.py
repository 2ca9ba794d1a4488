"""Mixing sources to target weights: blocks of words apportioned by highest averages.

All of it is DataFrame expressions: one shuffle of narrow rows by (source, shard) and no join but
that with the table of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm.registry import query, table
from tollgate.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words in a block, rows meant for one shard of a source, and the seed of the selection.
BLOCK = 32
SHARD_ROWS = 2_000
SEED = 17
#: A prime above any number of blocks of a shard, so that multiples of it visit all of them.
STRIDE = 2_654_435_761


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, source_rows, target): one row per source, null as a source.

    Sources in code-point order, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` times all words. A
    target stops at ``MOST`` times the source's words; what it cannot take goes to the others by
    weight. With sources in ascending order of limit / weight, the stopped ones come first: a
    source stops if its limit is at most its share of what those before it leave.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order) % len(WEIGHTS)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.when(turn == 0, len(WEIGHTS)).otherwise(turn)))
    limit = F.col("source_size") * MOST
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)).alias("weights_left"),
    )
    level = F.col("left") / F.col("weights_left")
    # the first source that does not stop sets the level of all after it
    opened = F.when(limit / F.col("weight") > level, level)
    first_open = F.first(opened, ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, 0))
    target = F.coalesce(first_open * F.col("weight"), limit.cast("double"))
    return s.select("source", "source_size", "source_rows", target.cast("double").alias("target"))


def seats(parties: DataFrame, party: str, votes: Column, house: Column, by: str) -> DataFrame:
    """``parties`` with ``seats``: the house of each group ``by`` shared by votes, whole and exactly.

    Sainte-Lague: seat k = 0, 1, ... of a party has the quotient votes / (2 k + 1), and the highest
    quotients win. Rounded shares are near that; what they give too little or too much is settled by
    ranking the next quotients, or the last ones, of equal ones those of the smaller ``party`` first.
    No party can gain or lose more than its share of the difference and of the number of
    parties, and one; so many quotients are ranked, which is in proportion to the parties.
    """
    group = Window.partitionBy(by)
    total, n = F.sum("__votes").over(group), F.count("*").over(group)
    share = F.when(F.col("__total") > 0, F.col("__votes") / F.col("__total")).otherwise(0.0)
    parties = parties.withColumns({"__votes": votes.cast("double"), "__house": house}).withColumns({"__total": total, "__n": n})
    parties = parties.withColumn("__base", F.floor(share * F.col("__house") + 0.5).cast("long"))
    parties = parties.withColumn("__rest", F.when(F.col("__total") > 0, F.col("__house") - F.sum("__base").over(group)).otherwise(F.lit(0)))
    most = F.least(F.abs("__rest"), F.ceil(share * (F.abs("__rest") + F.col("__n"))) + 1)
    most = F.when(F.col("__rest") < 0, F.least(most, F.col("__base"))).otherwise(most).cast("int")
    steps = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    more = F.col("__rest") > 0
    marginal = parties.select(by, party, "__rest", "__votes", "__base", F.explode(steps).alias("__j"))
    place = F.when(more, F.col("__base") + F.col("__j")).otherwise(F.col("__base") - 1 - F.col("__j"))
    quotient = F.col("__votes") / (2 * place + 1)
    order = Window.partitionBy(by).orderBy(F.when(more, -quotient).otherwise(quotient), F.when(more, F.col(party)).otherwise(-F.col(party)), "__j")
    won = marginal.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= F.abs("__rest")).groupBy(by, party).agg(F.count("*").alias("__won"))
    parties = parties.join(won, [by, party], "left")
    gained = F.coalesce("__won", F.lit(0)) * F.signum("__rest").cast("long")
    return parties.withColumn("seats", (F.col("__base") + gained).cast("long")).drop("__votes", "__house", "__total", "__n", "__base", "__rest", "__won")


def apportioned(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with source_size, target, whole and blocks: how often the
    mix takes the whole document, and the taken ranges [from, to) of its words besides.

    The blocks of all targets together go to the sources by highest quotients, and a source's blocks
    to its shards by their words in the same way (``seats``). A shard's rows lie end to
    end in order of id; after whole passes, the rest of its quota goes to single blocks, chosen
    without repeats by multiples of ``STRIDE`` from a seeded place. Shards go by id and size, so that
    null ids and ids with a common factor spread.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    targets = targets.withColumns({"__no": number, "__all_of_it": F.lit(0), "__blocks": F.floor(F.sum("target").over(everything) / BLOCK + 0.5)})
    targets = checkpointed(seats(targets, "__no", F.col("target"), F.col("__blocks"), "__all_of_it").drop("__all_of_it", "__blocks"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / SHARD_ROWS))
    # one row per source
    rows = rows.join(F.broadcast(targets.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    spot = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), shards) + F.col("size"), shards)
    rows = rows.withColumn("__shard", spot.cast("long")).withColumnRenamed("seats", "__quota")
    sized = rows.groupBy("__no", "__shard").agg(F.sum("size").alias("__words"), F.max("__quota").alias("__house"))
    quotas = seats(sized, "__shard", F.col("__words"), F.col("__house"), "__no").drop("__words")
    rows = rows.drop("__quota").join(quotas, ["__no", "__shard"])
    shard = Window.partitionBy("__no", "__shard")
    lie = shard.orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__all": F.sum("size").over(shard), "__end": F.sum("size").over(lie)})
    words = F.least(F.col("seats") * BLOCK, F.col("__all") * MOST)
    whole = F.when(F.col("__all") > 0, F.floor(words / F.col("__all"))).otherwise(0)
    rows = rows.withColumns({"__words": words, "whole": whole.cast("long")})
    rows = rows.withColumns(
        {
            "__pick": F.floor((F.col("__words") - F.col("whole") * F.col("__all")) / BLOCK + 0.5),
            "__n": F.ceil(F.col("__all") / BLOCK),
            "__start": F.col("__end") - F.col("size"),
        }
    )
    places = F.sequence(F.floor(F.col("__start") / BLOCK), F.floor((F.col("__end") - 1) / BLOCK))
    chosen = F.filter(places, lambda b: (b * STRIDE + SEED + F.col("__shard") * 7919) % F.col("__n") < F.col("__pick"))
    spans = F.transform(
        chosen,
        lambda b: F.struct(
            (F.greatest(F.col("__start"), b * BLOCK) - F.col("__start")).cast("long").alias("from"),
            (F.least(F.col("__end"), (b + 1) * BLOCK) - F.col("__start")).cast("long").alias("to"),
        ),
    )
    rows = rows.withColumn("blocks", F.when((F.col("size") > 0) & (F.col("__pick") > 0), spans).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>")))
    return rows.drop("__no", "__shard", "__all", "__end", "__words", "__pick", "__n", "__start", "source_rows", "seats")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of (doc_id, source, text).

    Null and empty texts have size 0 and nothing to take; a null source is one of its own; rows
    with a null or repeated id stay apart (equal rows may swap places); an empty table gives
    none. A source's blocks are its exact share; its taken words differ from them by less than a block
    per shard, since a shard's last block may be short.
    """
    sized = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rows = apportioned(sized, source_targets(sized))
    part = F.aggregate("blocks", F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"])
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time the mix takes a whole
    document, and one with the words of the taken blocks where it takes a part."""
    names = docs.columns
    others = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("__row")
    rows = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"), others)
    rows = apportioned(rows, source_targets(checkpointed(docs.select("source", word_count(F.col("text")).alias("size")))))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # a text is split once, whatever the number of its blocks: hence the array of one
    part = F.transform(
        F.array(F.struct(words.alias("words"), F.col("blocks").alias("blocks"))),
        lambda z: F.array_join(F.flatten(F.transform(z["blocks"], lambda x: F.slice(z["words"], (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")))), ""),
    )
    taken = F.aggregate("blocks", F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"])
    cut = F.when(taken == F.col("size"), F.array("text")).when(taken > 0, part).otherwise(F.array().cast("array<string>"))
    rows = rows.select("__row", F.explode(F.concat(F.array_repeat("text", F.col("whole").cast("int")), cut)).alias("__text"))
    return rows.select(*[F.col("__text").alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in names])


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM d GROUP BY source
), w AS (
  SELECT *, CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN {WEIGHTS[0]} WHEN 2 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM s
), l AS (
  SELECT *, {MOST} * source_size AS lim, row_number() OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST) AS i FROM w
), c AS (
  SELECT *, {SHARE}::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(coalesce(sum(lim) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
    CAST(sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS ws FROM l
), o AS (SELECT rest / ws AS level, i FROM c WHERE lim / weight > rest / ws ORDER BY i LIMIT 1
), t AS (
  SELECT source, source_size, source_rows, CASE WHEN c.i >= o.i THEN o.level * weight ELSE CAST(lim AS DOUBLE) END AS target FROM c LEFT JOIN o ON TRUE
), tn AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no, CAST(floor(sum(target) OVER () / {BLOCK} + 0.5) AS BIGINT) AS house, sum(target) OVER () AS votes, count(*) OVER () AS parties FROM t
), tb AS (SELECT *, CASE WHEN votes > 0 THEN target / votes ELSE 0 END AS share FROM tn
), tc AS (SELECT *, CAST(floor(share * house + 0.5) AS BIGINT) AS base FROM tb
), td AS (SELECT *, CASE WHEN votes > 0 THEN house - CAST(sum(base) OVER () AS BIGINT) ELSE 0 END AS rest FROM tc
), tm AS (SELECT *, unnest(range(CAST(least(abs(rest), ceil(share * (abs(rest) + parties)) + 1, CASE WHEN rest < 0 THEN base ELSE 9e18 END) AS BIGINT))) AS j FROM td
), tr AS (SELECT no, rest, row_number() OVER (ORDER BY CASE WHEN rest > 0 THEN -target / (2 * (base + j) + 1) ELSE target / (2 * (base - 1 - j) + 1) END, CASE WHEN rest > 0 THEN no ELSE -no END, j) AS rk FROM tm
), tw AS (SELECT no, count(*) AS won FROM tr WHERE rk <= abs(rest) GROUP BY no
), ts AS (SELECT td.*, base + coalesce(won, 0) * CAST(sign(rest) AS BIGINT) AS quota, CAST(greatest(1, ceil(source_rows / {SHARD_ROWS})) AS BIGINT) AS shards FROM td LEFT JOIN tw ON td.no = tw.no
), r AS (
  SELECT d.doc_id, d.source, d.size, ts.source_size, ts.target, ts.no, ts.quota, ((((coalesce(doc_id, 0) % shards) + shards) % shards) + d.size) % shards AS shard
  FROM d JOIN ts ON d.source IS NOT DISTINCT FROM ts.source
), sa AS (SELECT no, shard, CAST(sum(size) AS DOUBLE) AS votes, max(quota) AS house FROM r GROUP BY no, shard
), sb AS (SELECT *, sum(votes) OVER (PARTITION BY no) AS total, count(*) OVER (PARTITION BY no) AS parties FROM sa
), sc AS (SELECT *, CASE WHEN total > 0 THEN votes / total ELSE 0 END AS share FROM sb
), sd AS (SELECT *, CAST(floor(share * house + 0.5) AS BIGINT) AS base FROM sc
), se AS (SELECT *, CASE WHEN total > 0 THEN house - CAST(sum(base) OVER (PARTITION BY no) AS BIGINT) ELSE 0 END AS rest FROM sd
), sm AS (SELECT *, unnest(range(CAST(least(abs(rest), ceil(share * (abs(rest) + parties)) + 1, CASE WHEN rest < 0 THEN base ELSE 9e18 END) AS BIGINT))) AS j FROM se
), sr AS (SELECT no, shard, rest, row_number() OVER (PARTITION BY no ORDER BY CASE WHEN rest > 0 THEN -votes / (2 * (base + j) + 1) ELSE votes / (2 * (base - 1 - j) + 1) END, CASE WHEN rest > 0 THEN shard ELSE -shard END, j) AS rk FROM sm
), sw AS (SELECT no, shard, count(*) AS won FROM sr WHERE rk <= abs(rest) GROUP BY no, shard
), ss AS (SELECT se.no, se.shard, base + coalesce(won, 0) * CAST(sign(rest) AS BIGINT) AS seats FROM se LEFT JOIN sw ON se.no = sw.no AND se.shard = sw.shard
), p AS (
  SELECT r.*, seats, CAST(sum(size) OVER (PARTITION BY r.no, r.shard) AS BIGINT) AS total,
    CAST(sum(size) OVER (PARTITION BY r.no, r.shard ORDER BY doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fin FROM r JOIN ss ON r.no = ss.no AND r.shard = ss.shard
), q AS (
  SELECT *, least({BLOCK} * seats, {MOST} * total) AS words FROM p
), f AS (SELECT *, CASE WHEN total > 0 THEN words // total ELSE 0 END AS whole FROM q
), g AS (
  SELECT *, CAST(floor((words - whole * total) / {BLOCK} + 0.5) AS BIGINT) AS pick, CAST(ceil(total / {BLOCK}) AS BIGINT) AS n, fin - size AS beg FROM f
)
SELECT doc_id, size, source_size, target, CAST(whole * size + CASE WHEN size > 0 AND pick > 0 THEN coalesce(list_sum(list_transform(
    list_filter(range(beg // {BLOCK}, (fin - 1) // {BLOCK} + 1), lambda b: (b * {STRIDE} + {SEED} + shard * 7919) % n < pick),
    lambda b: least(fin, (b + 1) * {BLOCK}) - greatest(beg, b * {BLOCK}))), 0) ELSE 0 END AS BIGINT) AS taken
FROM g
"""


@query("op4_sainte_lague_mix", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
