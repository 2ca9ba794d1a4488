"""Embedding near-duplicates by an inverted multi-index: codebooks on vector halves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.components import Forest, components
from tollgate.llm.registry import query, table
from tollgate.session import checkpointed

THRESHOLD = 0.98
#: Most vectors on which the codebooks are fitted; vectors meant for one cell of the product
#: grid (that of all labels together); most codewords of a half.
FIT_ROWS = 8_192
CELL_SIZE = 2_000
MOST_WORDS = 128
#: Most lengths of vectors with codebooks of their own; the vectors of a rarer length are one cell.
MOST_LENGTHS = 8
#: Most vectors stored or asked in one task, and asked at once in a cell.
CHUNK = 16_000
BLOCK = 2_048


class Codebooks:
    """k-means on either half of unit vectors, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, words: int, rounds: int = 8):
        half = sample.shape[1] // 2
        self.half = half
        self.books = [kmeans(sample[:, :half], words, rounds), kmeans(sample[:, half:], words, rounds)]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def excess(self, x: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Own cell of each half-vector, and how far it is at least from every other cell: the
        distance to the plane between its own codeword and the other."""
        book, part = self.books[side], self.parts(x)[side]
        d = (part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)[None]
        own = d.argmin(axis=1)
        apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(axis=2))
        gap = d - d[np.arange(len(x)), own][:, None]
        return own, np.maximum(gap / np.maximum(2 * apart[own], 1e-12) - 1e-9, 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    book = x[np.linspace(0, len(x) - 1, k).astype(int)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        own = ((book**2).sum(axis=1)[None] - 2 * x @ book.T).argmin(axis=1)
        for c in range(len(book)):
            if (own == c).any():
                book[c] = x[own == c].mean(axis=0)
    return np.unique(book, axis=0)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def same_length(batches: Iterator[pa.RecordBatch], column: str = "v") -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches parted by the length of their vectors."""
    for batch in batches:
        lengths = np.diff(batch.column(column).offsets.to_numpy())
        for n in np.unique(lengths):
            yield int(n), batch if (lengths == n).all() else batch.take(pa.array(np.flatnonzero(lengths == n)))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of (vec_id, embedding, label): (vec_id, n_links, component_id, kept).

    Vectors of one label are linked if their cosine in double precision reaches the threshold.
    A vector visits the cells of the product grid in order of their least possible distance, until
    that is above the distance of a partner: so recall is 1 whatever the codebooks. Vectors of
    different lengths do not link; every length is searched in cells of its own.
    A null label, id or vector, a zero vector, and null or non-finite components link with
    nothing. Equal vectors are compared once, by their number. Equal ids stay separate rows. An
    empty table gives none.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    sound &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("h", F.when(sound, F.xxhash64("label", "v")))
    classes = checkpointed(rows.where("h is not null").groupBy("h").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
    spark, books = vectors.sparkSession, {}
    for r in classes.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(MOST_LENGTHS).collect():
        sample = classes.where(F.size("v") == r["size"]).orderBy("h").limit(FIT_ROWS).select("v").collect()
        words = min(MOST_WORDS, max(1, math.ceil(math.sqrt(r["count"] / CELL_SIZE))))
        books[r["size"]] = Codebooks(unit(np.array([x.v for x in sample])), words)
    if books:
        linked = checkpointed(_search(classes, books, threshold))
        found = components(linked.where("root is not null"), "h", "root")
        links = linked.groupBy("h").agg(F.sum("links").alias("links"))
        joined = classes.select("h", "n", "least").join(links, "h", "left").join(found.withColumnRenamed("node", "h"), "h", "left")
        joined = checkpointed(joined.withColumn("component", F.coalesce("component", "h")))
        named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
        facts = joined.join(named, "component").select("h", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    else:
        facts = spark.createDataFrame([], "h long, component_id long, n_links long")
    out = rows.select("vec_id", "h").join(facts, "h", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _search(classes: DataFrame, books: dict[int, Codebooks], threshold: float) -> DataFrame:
    """(h, links, root): a vector's links found in one task, and a link to what it is linked with
    there; at most one such row per vector and task, however many pairs there are."""
    reach = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, batch in same_length(batches):
            own, excess = np.zeros(batch.num_rows, int), np.zeros((batch.num_rows, 1))
            if size in books:
                own, excess = books[size].excess(unit(matrix(batch.column("v"))), 0)
            at, cell = np.nonzero(excess**2 <= reach)
            keep = cell >= own[at]  # a pair in two cells is found in the later one
            at, cell = at[keep], cell[keep]
            took = batch.take(pa.array(at))
            heads = [pa.array(np.full(len(at), size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(cell == own[at])]
            yield pa.RecordBatch.from_arrays([*heads, *took.columns], names=["size", "cell", "home", *took.schema.names])

    kinds = classes.select("label", "h", "n", "v")
    routed = checkpointed(kinds.mapInArrow(route, f"size int, cell int, home boolean, label {dict(kinds.dtypes)['label']}, h long, n long, v array<double>"))
    key = ["label", "size", "cell"]
    sizes = routed.groupBy(*key).agg(
        F.ceil(F.count_if("home") / CHUNK).cast("int").alias("stored"), F.ceil(F.count("*") / (2 * CHUNK)).cast("int").alias("asked")
    )
    placed = routed.join(sizes, key).where("stored > 0")
    mixed = F.xxhash64("h")
    as_stored = placed.where("home").select("*", F.pmod(mixed, F.col("stored")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("j"), F.lit(True).alias("kept"))
    as_asked = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("stored") - 1)).alias("i"), F.pmod(mixed, F.col("asked")).cast("int").alias("j"), F.lit(False).alias("kept"))

    def search(table_: pa.Table) -> pa.Table:
        table_ = table_.combine_chunks()
        kept = table_.column("kept").to_numpy()
        h, n, home = (table_.column(c).to_numpy() for c in ("h", "n", "home"))
        x = unit(matrix(table_.column("v").combine_chunks()))
        both, place = np.unique(h, return_inverse=True)
        s, q = np.flatnonzero(kept), np.flatnonzero(~kept)
        cell, size = (int(table_.column(c)[0].as_py()) for c in ("cell", "size"))
        bound, inner = np.zeros((len(q), 1)), np.zeros(len(s), int)
        if size in books:
            bound = books[size].excess(x[q], 0)[1][:, cell, None] ** 2 + books[size].excess(x[q], 1)[1] ** 2
            inner = books[size].excess(x[s], 1)[0]
        held = {int(c): s[inner == c] for c in np.unique(inner)}
        links, forest = np.zeros(len(both), np.int64), Forest(len(both))
        # multi-sequence order: every vector's next cell by least distance, as long as a partner may be there
        order = np.argsort(bound, axis=1, kind="stable")
        going = np.arange(len(q))
        for step in range(bound.shape[1]):
            going = going[bound[going, order[going, step]] <= reach]
            if not len(going):
                break
            at_step = order[going, step]
            for c in np.intersect1d(at_step, list(held)).tolist():
                t, asked = held[c], q[going[at_step == c]]
                for at in range(0, len(asked), BLOCK):
                    a = asked[at : at + BLOCK]
                    for to in range(0, len(t), BLOCK):
                        b = t[to : to + BLOCK]
                        near = (x[a] @ x[b].T >= threshold) & (h[a][:, None] != h[b][None])
                        i, j = np.nonzero(near)
                        np.add.at(links, place[a[i]], n[b[j]])
                        guest = ~home[a[i]]
                        np.add.at(links, place[b[j[guest]]], n[a[i[guest]]])
                        forest.link(place[a[i]], place[b[j]])
        some = np.flatnonzero((links > 0) | (forest.root != np.arange(len(both))))
        root = pa.array(both[forest.root[some]], mask=forest.root[some] == some)
        return pa.table({"h": both[some], "links": links[some], "root": root})

    columns = [*key, "i", "j", "kept", "home", "h", "n", "v"]
    units = as_stored.select(*columns).union(as_asked.select(*columns)).groupBy(*key, "i", "j")
    return units.applyInArrow(search, "h long, links long, root long")


@query("op9_inverted_multi_index")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
