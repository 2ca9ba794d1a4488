"""SimHash near-duplicates: fingerprints of word shingles, searched in a vantage-point tree.

The upper levels of the tree cut the space of fingerprints into shards; a fingerprint is stored
in one shard and asked in every shard that a ball of the wanted radius around it can reach by
the triangle inequality. In a shard the tree goes on to small leaves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.components import Forest, components
from tollgate.llm.registry import query, table
from tollgate.session import checkpointed

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Most fingerprints of the sample from which the upper tree is built on the driver.
TREE_SAMPLE = 16_384
#: Fingerprints meant for one shard, and most stored or asked in one task.
SHARD_SIZE = 24_000
CHUNK = 60_000
LEAF = 256
MAX_DEPTH = 12


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of all ``width``-word shingles of a text, repeats included; none without words.

    A-Z are lower-cased, words end at ASCII white space, a shorter text is one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].astype("<u8")
        set_bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of all shingles of a text; 0 without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row and ``fp``, its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(0)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp.view(np.int64))], names=[*batch.schema.names[1:], "fp"])

    chosen = docs.select(F.col(text).cast("binary").alias("__text"), *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]]
    return chosen.mapInArrow(run, ", ".join([*fields, "fp long"]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Tree:
    """Upper levels of a vantage-point tree as flat arrays; node i has the children 2i+1, 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.point = np.zeros(2**depth - 1, np.uint64)
        self.within = np.full(2**depth - 1, 64, np.int64)
        self._grow(0, 0, sample)

    def _grow(self, node: int, level: int, points: np.ndarray) -> None:
        if level == self.depth or not len(points):
            return
        vantage, mu = best_vantage(points)
        self.point[node], self.within[node] = vantage, mu
        near = distances(points, vantage) <= mu
        self._grow(2 * node + 1, level + 1, points[near])
        self._grow(2 * node + 2, level + 1, points[~near])

    def reach(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``points`` and the shards that a ball around each can touch."""
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            d = distances(points[at], self.point[node]).astype(np.int64)
            near = d - radius <= self.within[node]
            far = d + radius > self.within[node]
            at, node = np.concatenate([at[near], at[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
        return at, node - (2**self.depth - 1)


def best_vantage(points: np.ndarray, apart: Distance = distances) -> tuple[np.uint64, int]:
    """Of a few points, the one whose distances spread most, and the median distance from it."""
    probe = points[:: max(1, len(points) // 2048)]
    best = max(points[:: max(1, len(points) // 8)][:8], key=lambda p: apart(probe, p).std())
    d = np.sort(apart(probe, best).astype(np.int64))
    mu = int(d[len(d) // 2])
    return best, mu - 1 if mu == d[-1] and d[0] < mu else mu


def near_pairs(stored: np.ndarray, asked: np.ndarray, radius: int, apart: Distance = distances) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in ``stored``, in ``asked``) of all pairs within ``radius``, leaf by leaf. Points are
    rows of whatever ``apart`` measures."""
    work = [(np.arange(len(stored)), np.arange(len(asked)))]
    while work:
        s, q = work.pop()
        if not len(s) or not len(q):
            continue
        vantage, mu = best_vantage(stored[s], apart) if len(s) > LEAF else (None, 0)
        near = apart(stored[s], vantage) <= mu if vantage is not None else None
        if near is None or near.all() or not near.any():
            for at in range(0, len(s), LEAF):
                for to in range(0, len(q), 4096):
                    i, j = np.nonzero(apart(stored[s[at : at + LEAF], None], asked[None, q[to : to + 4096]]) <= radius)
                    yield s[at + i], q[to + j]
            continue
        d = apart(asked[q], vantage).astype(np.int64)
        work.append((s[near], q[d - radius <= mu]))
        work.append((s[~near], q[d + radius > mu]))


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct values of column ``fp`` that connect exactly what pairs
    within ``radius`` bits connect.

    A task returns one link per fingerprint and neighbourhood found, not its pairs. The sample
    for the upper tree and the tree itself are bounded (``TREE_SAMPLE``, ``MAX_DEPTH``); any
    sample gives the same connections. Crowded shards are cut into chunks of bounded size.
    """
    distinct = checkpointed(prints.select("fp").where("fp is not null").distinct())
    count = distinct.count()
    depth = min(MAX_DEPTH, max(1, math.ceil(math.log2(max(count, 1) / SHARD_SIZE + 1))))
    rows = distinct.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()
    tree = Tree(np.array([r.fp for r in rows], np.int64).view(np.uint64), depth)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            _, home = tree.reach(points, 0)  # one shard each, but in shard order
            order, home_of = tree.reach(points, 0)[0], np.empty(len(points), np.int64)
            home_of[order] = home
            at, shard = tree.reach(points, radius)
            # a pair of two shards is found once, in the later one
            keep = shard >= home_of[at]
            at, shard = at[keep], shard[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), pa.array(shard == home_of[at]), pa.array(points[at].view(np.int64))], names=["shard", "home", "fp"]
            )

    routed = checkpointed(distinct.mapInArrow(route, "shard int, home boolean, fp long"))
    # at most 2 ** MAX_DEPTH rows
    chunks = routed.groupBy("shard").agg(
        F.ceil(F.count_if("home") / CHUNK).cast("int").alias("stored"), F.ceil(F.count("*") / (2 * CHUNK)).cast("int").alias("asked")
    )
    placed = routed.join(F.broadcast(chunks), "shard").where("stored > 0")
    mixed = F.xxhash64("fp")
    as_stored = placed.where("home").select(
        "shard", F.pmod(mixed, F.col("stored")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("j"), F.lit(True).alias("kept"), "fp"
    )
    as_asked = placed.select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("stored") - 1)).alias("i"), F.pmod(mixed, F.col("asked")).cast("int").alias("j"), F.lit(False).alias("kept"), "fp"
    )

    def search(unit: pa.Table) -> pa.Table:
        fp, kept = unit.column("fp").to_numpy().view(np.uint64), unit.column("kept").to_numpy()
        both, place = np.unique(fp.view(np.int64), return_inverse=True)
        stored, asked = place[kept], place[~kept]
        forest, points = Forest(len(both)), both.view(np.uint64)
        for i, j in near_pairs(points[stored], points[asked], radius):
            forest.link(stored[i], asked[j])
        moved = np.flatnonzero(forest.root != np.arange(len(both)))
        return pa.table({"a": both[moved], "b": both[forest.root[moved]]})

    units = as_stored.union(as_asked).groupBy("shard", "i", "j")
    return units.applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, fp, component_id).

    ``component_id`` is the smallest id that can be reached over links of at most ``radius``
    differing bits. Null and wordless texts have the fingerprint 0 and link like any other;
    equal texts share a fingerprint; rows with a null id keep it and count as no smallest id
    (null where a component has none). Repeated rows stay repeated. An empty table gives none.
    """
    prints = checkpointed(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "doc_id"))
    found = components(near_links(prints, radius), "a", "b")
    # null: a fingerprint with no neighbour is its own component
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(found.withColumnRenamed("node", "fp"), "fp", "left")
    classes = checkpointed(classes.withColumn("component", F.coalesce("component", "fp")))
    named = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(classes.join(named, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


@query("op1_simhash_vp_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
