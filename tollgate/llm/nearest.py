"""Approximate nearest neighbours by an inverted multi-index.

Either half of the vectors has a codebook of its own; the pairs of codewords are the cells of a grid. A
query takes the cells in order of its summed inner products with the two codewords, from a heap, until
they hold enough vectors, and its candidates are reranked by exact inner products. How many vectors are
enough is measured: probe queries are compared with all vectors first.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm.multiindex import kmeans, matrix, same_length
from tollgate.llm.registry import query, table
from tollgate.session import checkpointed

NEIGHBOURS = 20
#: Share of the probes' true neighbours that the candidates must hold, and most probes.
RECALL = 0.95
PROBES = 96
#: Most vectors on which codebooks are fitted; vectors meant for a cell; most codewords of a half;
#: most lengths of vectors with codebooks of their own (the vectors of a rarer length are one cell).
FIT_ROWS = 8_192
CELL_SIZE = 8
MOST_WORDS = 256
MOST_LENGTHS = 8
#: Most vectors stored or asked in one task, and asked at once there.
CHUNK = 16_000
BLOCK = 256


class Grid:
    """Codebooks of both halves, the number of vectors in each cell once they are counted, and the
    shards, each of which holds the cells of every ``shards``-th codeword of the first half."""

    def __init__(self, sample: np.ndarray, words: int, shards: int = 1):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(part, words) for part in self.parts(sample)]
        self.counts = np.zeros((len(self.books[0]), len(self.books[1])), np.int64)
        self.shards = min(shards, len(self.books[0]))
        self.enough = 0

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = (((b**2).sum(axis=1)[None] - 2 * part @ b.T).argmin(axis=1) for part, b in zip(self.parts(x), self.books))
        return one, two

    def visit(self, vector: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(i, j, vectors) of all cells, by falling sum of the inner products with their codewords."""
        first, second = (-(b @ part) for part, b in zip((vector[: self.half], vector[self.half :]), self.books))
        one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        counts = self.counts[one][:, two].tolist()
        first, second = first[one].tolist(), second[two].tolist()
        one, two = one.tolist(), two.tolist()
        heap = [(first[0] + second[0], 0, 0)]
        while heap:
            _, a, b = heap[0]
            yield one[a], two[b], counts[a][b]
            if b + 1 < len(two):
                heapq.heapreplace(heap, (first[a] + second[b + 1], a, b + 1))
            else:
                heapq.heappop(heap)
            # a row of cells is begun once the row before it is
            if b == 0 and a + 1 < len(one):
                heapq.heappush(heap, (first[a + 1] + second[0], a + 1, 0))

    def reach(self, vector: np.ndarray) -> np.ndarray:
        """Which cells are visited until they hold enough vectors."""
        seen, held = np.zeros(self.counts.size, bool), 0
        width, cells = self.counts.shape[1], []
        for i, j, n in self.visit(vector):
            cells.append(i * width + j)
            held += n
            if held >= self.enough:
                break
        seen[cells] = True
        return (seen & (self.counts.ravel() > 0)).reshape(self.counts.shape)


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, summed in order of the components, so equal vectors have equal products."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def best(x: np.ndarray, name: np.ndarray, row: np.ndarray, q: np.ndarray, own: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score): the ``k`` largest exact inner products of every query with entries it
    may meet and that have another name; of equal ones the smaller name, then the smaller row."""
    rough = q @ x.T
    rough[~may | (own[:, None] == name[None])] = -np.inf
    if len(x) > k:
        margin = 1e-10 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] - margin
        near = (rough >= least[:, None]) & (rough > -np.inf)
    else:
        near = rough > -np.inf
    at, entry = np.nonzero(near)
    score = inner(q[at], x[entry])
    order = np.lexsort((row[entry], name[entry], -score, at))
    at, entry, score = at[order], entry[order], score[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    return at[nth < k], entry[nth < k], score[nth < k]


def _fitted(entries: DataFrame) -> dict[int, Grid]:
    """Codebooks of the most frequent lengths, from bounded samples."""
    sizes = entries.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(MOST_LENGTHS).collect()
    grids = {}
    for r in sizes:
        sample = entries.where(F.size("v") == r["size"]).orderBy(F.xxhash64("v"), "row").limit(FIT_ROWS).select("v").collect()
        words = min(MOST_WORDS, max(1, math.ceil(math.sqrt(r["count"] / CELL_SIZE))))
        grids[r["size"]] = Grid(np.array([s.v for s in sample]), words, math.ceil(r["count"] / CHUNK))
    return grids


def _measure(grids: dict[int, Grid], placed: DataFrame, asked: DataFrame, k: int, recall: float) -> None:
    """Count the cells, and set how many vectors the traversal must hold so that it meets the share
    ``recall`` of the true neighbours of the probes, which are found in one pass over all vectors."""
    for r in placed.groupBy("size", "i", "j").count().where(F.col("size").isin([*grids])).collect():
        grids[r["size"]].counts[r.i, r.j] = r["count"]
    probes = {n: asked.where(F.size("v") == n).orderBy(F.xxhash64("row"), "row").limit(PROBES).collect() for n in grids}
    sets = {n: (np.array([p.v for p in ps]), np.array([p.vec_id for p in ps])) for n, ps in probes.items() if ps}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in same_length(batches):
            if n not in sets:
                continue
            name, row, i, j = (batch.column(c).to_numpy() for c in ("vec_id", "row", "i", "j"))
            q, own = sets[n]
            at, entry, score = best(matrix(batch.column("v")), name, row, q, own, np.ones((len(q), 1), bool), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (np.full(len(at), n, np.int32), at.astype(np.int32), name[entry], row[entry], score, i[entry], j[entry])],
                names=["size", "probe", "vec_id", "row", "score", "i", "j"],
            )

    found = placed.mapInArrow(compare, "size int, probe int, vec_id long, row long, score double, i int, j int")
    top = Window.partitionBy("size", "probe").orderBy(F.desc("score"), "vec_id", "row")
    needs: dict[int, list[int]] = {n: [] for n in grids}
    cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in found.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k).collect():
        cells.setdefault((r["size"], r.probe), []).append((r.i, r.j))
    for (n, probe), wanted in cells.items():
        held, left = 0, set(wanted)
        for i, j, count in grids[n].visit(sets[n][0][probe]):
            held += count
            if (i, j) in left:
                needs[n] += [held] * wanted.count((i, j))
                left.remove((i, j))
                if not left:
                    break
    for n, grid in grids.items():
        need = sorted(needs[n])
        grid.enough = max(2 * k, need[math.ceil(recall * len(need)) - 1] if need else 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, embedding): for each query row the ``k`` vectors
    found of largest inner product in double precision, ties to the smaller id; all, if fewer.

    Null, zero and non-finite vectors, null components and null ids take no part. Vectors are only
    compared with those of their length. Rows of a query's own id are not its candidates; a
    repeated row is a candidate each time and a query each time. Of equal vectors the first
    ``k`` + 1 by id can be among the nearest, and only they are stored. Of vectors of a length
    with codebooks, the share ``recall`` of probes' neighbours is found; with 1, and for the
    rarer lengths, the search is complete. An empty table gives none.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    sound &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = checkpointed(rows.where(sound).withColumn("row", F.monotonically_increasing_id()))
    equal = Window.partitionBy("v").orderBy("vec_id", "row")
    entries = checkpointed(rows.withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k + 1).select("vec_id", "row", "v"))
    asked = rows.where("asks").select("vec_id", "row", "v")
    grids = _fitted(entries)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in same_length(batches):
            i, j = grids[n].cells(matrix(batch.column("v"))) if n in grids else (np.zeros(batch.num_rows),) * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, n, np.int32)), *(pa.array(x.astype(np.int32)) for x in (i, j)), *batch.columns], names=["size", "i", "j", *batch.schema.names]
            )

    placed = checkpointed(entries.mapInArrow(place, "size int, i int, j int, vec_id long, row long, v array<double>"))
    _measure(grids, placed, asked, k, recall if recall < 1 else 1.0)
    if recall >= 1:
        for grid in grids.values():
            grid.enough = 2**62

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in same_length(batches):
            at, shard, cells = [], [], []
            for place, v in enumerate(matrix(batch.column("v"))):
                seen = grids[n].reach(v) if n in grids else np.ones((1, 1), bool)
                shards = grids[n].shards if n in grids else 1
                for part in range(shards):
                    if (own := seen[part::shards]).any():
                        at.append(place)
                        shard.append(part)
                        cells.append(np.packbits(own).tobytes())
            took = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), n, np.int32)), pa.array(shard, pa.int32()), pa.array(cells, pa.binary()), *took.columns], names=["size", "shard", "cells", *took.schema.names]
            )

    routed = checkpointed(asked.mapInArrow(ask, "size int, shard int, cells binary, vec_id long, row long, v array<double>"))
    shards = F.coalesce(F.create_map(*[F.lit(x) for n, g in grids.items() for x in (n, g.shards)])[F.col("size")], F.lit(1)) if grids else F.lit(1)
    width = F.coalesce(F.create_map(*[F.lit(x) for n, g in grids.items() for x in (n, g.counts.shape[1])])[F.col("size")], F.lit(1)) if grids else F.lit(1)
    entry_of = placed.withColumns({"shard": F.col("i") % shards, "cell": F.floor(F.col("i") / shards).cast("int") * width + F.col("j")})
    stored = entry_of.groupBy("size", "shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("stored"))
    sizes = routed.groupBy("size", "shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("asked")).join(stored, ["size", "shard"])
    mixed = F.xxhash64("row")
    a, b = F.pmod(mixed, F.col("stored")).cast("int"), F.pmod(mixed, F.col("asked")).cast("int")
    columns = ["size", "shard", "a", "b", "cell", "cells", "vec_id", "row", "v"]
    as_stored = entry_of.join(sizes, ["size", "shard"]).withColumns({"a": a, "b": F.explode(F.sequence(F.lit(0), F.col("asked") - 1)), "cells": F.lit(None).cast("binary")})
    as_asked = routed.join(sizes, ["size", "shard"]).withColumns({"b": b, "a": F.explode(F.sequence(F.lit(0), F.col("stored") - 1)), "cell": F.lit(None).cast("int")})

    def rerank(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        cell, name, row = unit.column("cell"), unit.column("vec_id").to_numpy(), unit.column("row").to_numpy()
        x = matrix(unit.column("v").combine_chunks())
        s, q = np.flatnonzero(cell.is_valid().to_numpy()), np.flatnonzero(cell.is_null().to_numpy())
        of, cells = cell.drop_null().to_numpy(), unit.column("cells").combine_chunks().take(pa.array(q))
        out = []
        for lo in range(0, len(q) if len(s) else 0, BLOCK):
            some = q[lo : lo + BLOCK]
            bits = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in cells[lo : lo + BLOCK]])
            may = np.unpackbits(bits, axis=1).view(bool)[:, of]
            at, entry, score = best(x[s], name[s], row[s], x[some], name[some], may, k)
            out.append((some[at], s[entry], score))
        at, entry, score = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"query_row": row[at], "query_id": name[at], "row": row[entry], "vec_id": name[entry], "score": score})

    units = as_stored.select(*columns).union(as_asked.select(*columns)).groupBy("size", "shard", "a", "b")
    found = units.applyInArrow(rerank, "query_row long, query_id long, row long, vec_id long, score double")
    top = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op12_multi_index_search")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
