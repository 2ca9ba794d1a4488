"""Near copies of documents: SimHash fingerprints, vantage-point trees, exact shingle similarity.

Texts of a similarity of 0.8 differ in a sixth of their fingerprints' bits. A ball so wide touches all
shards of a tree over random fingerprints, so the shards are formed otherwise: by a few least hashes
that similar texts share. In a shard a tree finds near fingerprints, and the texts of what hangs
together by these are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.components import Forest, components
from tollgate.llm.registry import small_batches
from tollgate.llm.simhash import majority, near_pairs, shingle_hashes
from tollgate.operators.keyed import attach
from tollgate.session import checkpointed

WIDTH = 5
SIMILARITY = 0.8
#: Differing bits, of 128, up to which texts are compared: at a similarity of 0.8 one expects 19 and
#: fewer than one pair in a hundred has more; between unrelated texts one expects 64.
RADIUS = 30
#: Bands of least hashes: texts of a similarity of 0.8 share one at least in 98.6 % of all cases.
BANDS, DEPTH = 6, 3
#: Fingerprints, texts and text bytes meant for one side of a task.
CHUNK = 20_000
TEXTS = 1_500
TEXT_BYTES = 12_000_000

_ODD = (np.random.default_rng(7).integers(0, 2**63, BANDS * DEPTH + DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Further hashes from hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(text: bytes | None, width: int = WIDTH) -> tuple[list[int], list[int]]:
    """Fingerprint of 128 bits as two words, and the bands. Texts without words have zeros."""
    h = shingle_hashes(text, width)
    if not len(h):
        return [0, 0], [0] * BANDS
    second = mixed(h)
    least = np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 16_384):
        np.minimum(least, (second[at : at + 16_384, None] * _ODD[None, : BANDS * DEPTH]).min(axis=0), out=least)
    bands = (least.reshape(BANDS, DEPTH) * _ODD[None, BANDS * DEPTH :]).sum(axis=1, dtype=np.uint64)
    return [majority(h), majority(second)], bands.tolist()


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [sketch(x.as_py(), width) for x in batch.column(0)]
            longs = [[np.array(x[k], np.uint64).view(np.int64).tolist() for x in both] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x, pa.list_(pa.int64())) for x in longs)], names=[*batch.schema.names[1:], "print", "bands"])

    chosen = rows.select(F.col("text").cast("binary").alias("text"), "key", "mixed", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return chosen.mapInArrow(run, "key long, mixed long, bytes long, print array<long>, bands array<long>")


def _sides(rows: DataFrame, group: str, parts: str) -> DataFrame:
    """Every row in all tasks (group, i, j), i <= j, that compare its part, by hash, with others."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("mixed"), F.col(parts)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)))
    return rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", parts)


def _two(unit: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names and fingerprints of a task, and the places of its two sides."""
    name, part = unit.column("mixed").to_numpy(), unit.column("part").to_numpy()
    prints = unit.column("print").combine_chunks().flatten().to_numpy().reshape(-1, 2).view(np.uint64)
    return name, prints, np.flatnonzero(part == unit.column("i")[0].as_py()), np.flatnonzero(part == unit.column("j")[0].as_py())


def _links(name: np.ndarray, forest: Forest) -> pa.Table:
    moved = np.flatnonzero(forest.root != np.arange(len(name)))
    return pa.table({"a": name[moved], "b": name[forest.root[moved]]})


def _near(unit: pa.Table) -> pa.Table:
    """Links that connect what the task's near fingerprints connect."""
    name, prints, one, two = _two(unit)
    forest = Forest(len(name))
    for i, j in near_pairs(prints[one], prints[two], RADIUS, bits_apart):
        forest.link(one[i], two[j])
    return _links(name, forest)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, sorted and distinct; that of two empty ones is 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int((a[at] == b).sum())
    return common / (len(a) + len(b) - common)


def similar_links(texts: DataFrame, least: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(a, b): links between the ``mixed`` of (mixed, bytes, print, bands, text) that connect what
    similar texts connect. A pair that hangs together already is not compared again."""
    slots = texts.select("mixed", "print", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("slot"), "mixed", "print")
    sizes = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    sides = _sides(attach(slots, sizes.withColumn("parts", F.ceil(F.col("n") / CHUNK)), "slot", "n"), "slot", "parts")
    near = sides.groupBy("slot", "i", "j").applyInArrow(_near, "a long, b long")
    found = components(near, "a", "b")
    # the smallest node of a component has no row of its own
    members = found.union(found.select(F.col("component").alias("node"), "component").distinct()).distinct()
    rows = checkpointed(members.join(texts.select(F.col("mixed").alias("node"), "mixed", "bytes", "print", "text"), "node").drop("node"))
    parts = F.greatest(F.ceil(F.col("n") / TEXTS), F.ceil(F.col("all") / TEXT_BYTES))
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("all")).select("component", "n", parts.alias("parts"))
    sides = _sides(attach(rows, sizes, "component", "n"), "component", "parts")

    def compare(unit: pa.Table) -> pa.Table:
        name, prints, one, two = _two(unit)
        sets = [np.unique(shingle_hashes(x.as_py(), width)) for x in unit.column("text")]
        size = np.array([len(x) for x in sets])
        forest = Forest(len(name))
        for i, j in near_pairs(prints[one], prints[two], RADIUS, bits_apart):
            a, b = one[i], two[j]
            keep = (a != b) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]))
            a, b = a[keep], b[keep]
            while len(a):
                open_ = forest.root[a] != forest.root[b]
                a, b = a[open_], b[open_]
                some = [k for k in range(min(len(a), 64)) if similarity(sets[a[k]], sets[b[k]]) >= least]
                forest.link(a[some], b[some])
                a, b = a[64:], b[64:]
        return _links(name, forest)

    columns = ["component", "i", "j", "part", "mixed", "print", F.col("text").cast("binary").alias("text")]
    return sides.select(*columns).groupBy("component", "i", "j").applyInArrow(compare, "a long, b long")


def one_of_each(docs: DataFrame, least: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of every group of near copies: of the smallest id, then of the smallest
    hash of the text; of equal rows with that id and text one stays.

    Texts are linked if ``least`` of their distinct ``width``-word shingles, of both together, are
    common, as far as fingerprints and bands let them meet (see ``RADIUS``, ``BANDS``). Texts
    without words, null and empty ones included, are copies of each other. A null id counts
    as the largest. An empty table gives none.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).cast("long").alias("key"), F.xxhash64("text").alias("mixed"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    with small_batches(docs.sparkSession, 1_000):
        prints = checkpointed(_sketches(rows, width))
    texts = checkpointed(prints.groupBy("mixed").agg(F.min("key").alias("key"), F.first("bytes").alias("bytes"), F.first("print").alias("print"), F.first("bands").alias("bands")))
    found = components(similar_links(_with_text(texts, rows), least, width), "a", "b")
    classes = texts.select("key", "mixed").join(found.withColumnRenamed("node", "mixed"), "mixed", "left").groupBy(F.coalesce("component", "mixed").alias("component"))
    kept = classes.agg(F.min(F.struct("key", "mixed")).alias("kept")).select("kept.*")
    nth = F.row_number().over(Window.partitionBy("key", "mixed").orderBy("key"))
    return rows.select("key", "mixed", "row").join(kept, ["key", "mixed"], "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")


def _with_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``texts`` that share a band with another one, with their text."""
    slots = texts.select("key", "mixed", F.posexplode("bands").alias("band", "value"))
    shared = slots.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    some = checkpointed(slots.join(shared, ["band", "value"], "left_semi").select("key", "mixed").distinct())
    found = rows.select("key", "mixed", "text").join(some, ["key", "mixed"], "left_semi").groupBy("mixed").agg(F.first("text").alias("text"))
    return checkpointed(texts.drop("key").join(found, "mixed"))
