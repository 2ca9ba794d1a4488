"""Benchmark decontamination: q-gram counts in diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.registry import query, table
from tollgate.session import checkpointed

#: Edits allowed per character of an item.
EDIT_RATE = 0.1
#: Characters of benchmark text in one block; each block is one pass over the documents.
BLOCK_CHARS = 2_000_000
#: Characters of documents searched together.
TOGETHER = 400_000
LONG_Q, SHORT_Q = 8, 4
GAP = np.uint32(0x110000)  # no character
MIX = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling; q is 1, 2, 4 or 8."""
    with np.errstate(over="ignore"):
        h, step = (chars.astype(np.uint64) + np.uint64(1)) * MIX, 1
        while step < q:
            if len(h) <= step:
                return np.empty(0, np.uint64)
            h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * MIX + h[step:]
            step *= 2
        return h


class Items:
    """The q-gram index of a block of benchmark items that share q."""

    def __init__(self, ids: list, texts: list[str], q: int):
        self.q, self.ids, self.items = q, ids, [points(t) for t in texts]
        self.length = np.array([len(x) for x in self.items], np.int64)
        self.budget = (EDIT_RATE * self.length).astype(np.int64)
        # q-gram lemma: an edit spoils at most q of the item's q-grams
        self.least = np.maximum(1, self.length - q + 1 - self.budget * q)
        hashes = [grams(x, q) for x in self.items]
        item = np.repeat(np.arange(len(ids)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def regions(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, lowest diagonal) of all bands that share enough q-grams with an item.

        Bands are two steps of budget + 1 diagonals wide and start at every step, so that the
        diagonals of any occurrence within the budget lie in one of them.
        """
        h = grams(chars, self.q)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - FILTER_BITS)])
        slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[slot] == h[at]
        at, slot = at[same], slot[same]
        n = self.count[slot]
        posting = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, place = self.item[posting], self.place[posting]
        step = self.budget[item] + 1
        band = (np.repeat(at, n) - place) // step
        low = int(band.min(initial=0)) - 1
        span, length = int(band.max(initial=0)) - low + 2, int(self.length.max()) + 1
        keys = np.concatenate([(item * span + (b - low)) * length + place for b in (band, band - 1)])
        keys = np.unique(keys) // length  # an item's q-gram counts once in a band
        keys, shared = np.unique(keys, return_counts=True)
        item, band = keys // span, keys % span + low
        enough = shared >= self.least[item]
        return item[enough], band[enough] * (self.budget[item[enough]] + 1)


def align(item: np.ndarray, text: np.ndarray, budget: int, low: int, width: int, free: bool = True) -> tuple[int, int]:
    """Least edits between the item and a part of the text, and where that part ends, for paths
    on the diagonals low .. low + width - 1; ``free``: the part may start anywhere, not just at 0."""
    n, t = len(item), np.arange(width)
    padded = np.full(n + width, GAP, np.uint32)
    a, b = max(0, low), min(len(text), low + n + width)
    if b > a:
        padded[a - low : b - low] = text[a:b]
    big = n + width + 1
    d = np.zeros(width, np.int64) if free else np.where(t + low >= 0, t + low, big)
    for i in range(n):
        skip = np.append(d[1:], big) + 1
        d = np.minimum(d + (padded[i : i + width] != item[i]), skip)
        d = np.minimum.accumulate(d - t) + t
        if d.min() > budget:
            return big, 0
    best = int(d.argmin())
    return int(d[best]), low + n + best


def find(items: Items, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of the closest occurrence of each item in each text."""
    parts, starts, at = [], [], 0
    for t in texts:
        starts.append(at)
        parts += [points(t), np.array([GAP])]
        at += len(parts[-2]) + 1
    chars, starts = np.concatenate(parts), np.array(starts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, low in zip(*items.regions(chars)):
        i, k = int(i), int(items.budget[i])
        width = 2 * (k + 1) + 2 * k
        middle = min(max(int(low) + int(items.length[i]) // 2, 0), len(chars) - 1)
        for d in {int(np.searchsorted(starts, min(max(p, 0), len(chars) - 1), side="right")) - 1 for p in (int(low), middle, int(low) + int(items.length[i]))}:
            text = parts[2 * d]
            edits, end = align(items.items[i], text, k, int(low) - k - int(starts[d]), width)
            if edits <= k and edits < best.get((d, i), (k + 1,))[0]:
                best[d, i] = (edits, 0, end)
    out = []
    for (d, i), (edits, _, end) in best.items():
        k = int(items.budget[i])
        # from the end backwards, for the start
        _, back = align(items.items[i][::-1], parts[2 * d][:end][::-1], k, -k, 2 * k + 1, free=False)
        out.append((d, i, edits, end - back, end))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of documents that hold a benchmark item, one row per row and item,
    with item_id, edits, item_chars, start and end (characters of the normalised text).

    An occurrence is a part of the normalised document within EDIT_RATE edits per character of
    the normalised item; the closest one is told. All items are searched in all documents,
    in blocks of bounded size. Null and empty items and texts match nothing; repeated rows and
    items give a row each; without items or documents there are none.
    """
    chosen = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    more = T._parse_datatype_string(f"item_id {dict(benchmark.dtypes)['item_id']}, edits int, item_chars int, start long, end long")
    schema = T.StructType([*chosen.schema.fields[1:], *more.fields])
    out = docs.sparkSession.createDataFrame([], schema)
    for n, indexes in enumerate(_blocks(benchmark)):
        # a finished block's index need not stay on the driver
        out = (checkpointed(out) if n else out).union(_search(chosen, indexes, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, in one pass per block and no shuffle. Null
    and empty texts hold none; repeated rows stay or go together; an empty table stays empty."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for n, indexes in enumerate(_blocks(benchmark)):
        rows = _filter(checkpointed(rows) if n else rows, indexes)
    return rows.select("row.*")


def _blocks(benchmark: DataFrame) -> Iterator[list[Items]]:
    """Indexes of the benchmark's items, a block of bounded size at a time."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    for b in range(blocks):
        groups: dict[int, tuple[list, list]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect():
            if text := normal(r.text):
                k = int(EDIT_RATE * len(text))
                q = next((q for q in (LONG_Q, SHORT_Q, 2, 1) if len(text) - q + 1 - k * q >= (3 if q == LONG_Q else 1)), 1)
                ids, texts = groups.setdefault(q, ([], []))
                ids.append(r.item_id)
                texts.append(text)
        if groups:
            yield [Items(ids, texts, q) for q, (ids, texts) in groups.items()]


def _portions(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Place of the first and normalised texts of portions of about TOGETHER characters."""
    texts, first, size = [], 0, 0
    for at, x in enumerate(column):
        texts.append(normal(x.as_py()))
        size += len(texts[-1])
        if size >= TOGETHER:
            yield first, texts
            texts, first, size = [], at + 1, 0
    if texts:
        yield first, texts


def _filter(docs: DataFrame, indexes: list[Items]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.zeros(batch.num_rows, bool)
            for first, texts in _portions(batch.column("text")):
                held[[first + f[0] for ix in indexes for f in find(ix, texts)]] = True
            yield batch.filter(pa.array(~held))

    return docs.mapInArrow(run, docs.schema)


def _search(chosen: DataFrame, indexes: list[Items], schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _portions(batch.column(0)):
                found = [(first + d, ix.ids[i], e, len(ix.items[i]), s, t) for ix in indexes for d, i, e, s, t in find(ix, texts)]
                if found:
                    kept = batch.take(pa.array([f[0] for f in found])).columns[1:]
                    cols = [pa.array([f[c] for f in found]) for c in range(1, 6)]
                    cols[1], cols[2] = cols[1].cast(pa.int32()), cols[2].cast(pa.int32())
                    yield pa.RecordBatch.from_arrays([*kept, *cols], names=[*batch.schema.names[1:], "item_id", "edits", "item_chars", "start", "end"])

    return chosen.mapInArrow(run, schema)


@query("op8_qgram_bands")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
