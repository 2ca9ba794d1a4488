"""Substring deduplication: bytes covered by a long string that starts earlier are removed.

Two equal strings of LENGTH bytes hold the same lowest-hashed GRAM, at the same place. Runs of
string starts with the same such gram (a stretch) go to a bucket by its hash, so equal strings
meet. In a bucket, stretches that share enough with another become strings of shards whose
Burrows-Wheeler transforms are merged; intervals of LENGTH common bytes tell the repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm import bwt
from tollgate.llm.registry import query, table
from tollgate.session import checkpointed

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM  # a gram starts at most so far into a string
WIDTH = 2 * SPAN + GRAM
#: Of any string around a gram, so many bytes lie wholly before or wholly after the gram.
SIDE = SPAN // 2
#: Bytes of text cut together (their arrays fit a processor's cache), bytes of signs or
#: stretches that a task deals out at once, and bytes of text meant for one bucket.
TOGETHER = 300_000
DEALT = 8_000_000
BUCKET_BYTES = 6_000_000
NO_ID = -(2**63)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A sign: the gram's hash, hashes of the bytes beside it, the document's key. A stretch: its document, the place of its gram, how far before it the first and the last
#: string start, the gram's hash and the bytes around the gram (0 outside the strings).
SIGN = np.dtype([("hash", "<u4"), ("left", "<u2"), ("right", "<u2"), ("key", "<i8")])
STRETCH = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("gram", "<i8"), ("hash", "<u4"), ("first", "u1"), ("last", "u1"), ("bytes", "u1", (WIDTH,))])


def _mixed(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes (a multiple of 8 wide)."""
    h = np.zeros(len(rows), np.uint64)
    words = np.ascontiguousarray(rows).view("<u8")
    with np.errstate(over="ignore"):
        for c in range(words.shape[1]):
            h = (h ^ words[:, c]) * MIX
            h ^= h >> np.uint64(29)
    return h


class Runs:
    """The runs of string starts of some texts that share a lowest gram."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        self.data = data = np.frombuffer(b"".join(texts) + bytes(WIDTH), np.uint8)
        n = len(data) - WIDTH
        with np.errstate(over="ignore"):
            h = (data.astype(np.uint64) + np.uint64(1)) * MIX
            parts = [h]
            for step in (1, 2, 4, 8):
                p = parts[-1]
                parts.append((p[:-step] ^ (p[:-step] >> np.uint64(29))) * MIX + p[step:])
            h = (parts[4][:-8] ^ (parts[4][:-8] >> np.uint64(29))) * MIX + parts[3][16 : 16 + len(parts[4]) - 8]
            self.grams = h = (h ^ (h >> np.uint64(32))) * MIX
        # the lowest hash, then the leftmost place, in every window of SPAN + 1 grams
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= SPAN + 1:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = SPAN + 1 - reach
        low = np.minimum(low[: len(low) - rest], low[rest:])[: max(0, n - LENGTH + 1)]
        starts = np.arange(len(low))
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(low)]
        inside = starts + LENGTH <= ends[owner]
        starts, owner, low = starts[inside], owner[inside], low[inside]
        new = np.concatenate([np.ones(min(1, len(low)), bool), (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])
        at = np.flatnonzero(new)
        last = starts[np.append(at[1:], len(starts))[: len(at)] - 1]
        self.owner, low = owner[new], low[new]
        self.gram = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.place = self.gram - (ends - sizes)[self.owner]
        self.hash = (low >> np.uint64(32)).astype(np.uint32)
        self.first, self.last = self.gram - starts[new], self.gram - last

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Short hashes of the SIDE bytes before and after the gram, 0 where no string holds them."""
        out = []
        for a, whole in ((self.gram - SIDE, self.first >= SIDE), (self.gram + GRAM, SPAN - self.last >= SIDE)):
            a = np.where(whole, a, 0)
            with np.errstate(over="ignore"):
                h = (self.grams[a] * MIX) ^ self.grams[a + SIDE - GRAM]
            out.append(np.where(whole, (h >> np.uint64(48)) | np.uint64(1), 0).astype(np.uint16))
        return out[0], out[1]


def stretches(texts: list[bytes], docs: np.ndarray, ties: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
    """The stretches of the texts whose grams have a hash that is wanted of their text."""
    runs = Runs(texts)
    keep = np.zeros(len(runs.hash), bool)
    cuts = np.searchsorted(runs.owner, np.arange(len(texts) + 1))
    for a, b, want in zip(cuts, cuts[1:], wanted):
        keep[a:b] = np.isin(runs.hash[a:b], want)
    gram, first, last = runs.gram[keep], runs.first[keep], runs.last[keep]
    out = np.empty(len(gram), STRETCH)
    out["doc"], out["tie"], out["hash"] = docs[runs.owner[keep]], ties[runs.owner[keep]], runs.hash[keep]
    out["gram"], out["first"], out["last"] = runs.place[keep], first, last
    around = sliding_window_view(np.concatenate([np.zeros(SPAN, np.uint8), runs.data]), WIDTH)
    place = np.arange(WIDTH)[None]
    for at in range(0, len(gram), 20_000):
        s = slice(at, at + 20_000)
        out["bytes"][s] = around[gram[s]] * ((place >= SPAN - first[s, None]) & (place < SPAN - last[s, None] + LENGTH))
    return out


def shared(signs: np.ndarray) -> np.ndarray:
    """Of a bucket's signs, those of a gram that another sign has with the same bytes before it or
    with the same bytes after it: no other stretch can hold a string that comes up twice."""
    out = np.zeros(len(signs), bool)
    for side in ("left", "right"):
        key = (signs["hash"].astype(np.uint64) << np.uint64(16)) | signs[side]
        at = np.flatnonzero(signs[side])
        _, inverse, count = np.unique(key[at], return_inverse=True, return_counts=True)
        out[at] |= count[inverse] > 1
    return signs[out]


def _in_order(rows: np.ndarray) -> np.ndarray:
    """Rows in the order of documents and places; a place told twice (equal rows) counts once."""
    rows = rows[np.lexsort((rows["gram"], rows["tie"], rows["doc"]))]
    place = rows[["doc", "tie", "gram"]]
    return rows[np.concatenate([np.ones(min(1, len(rows)), bool), place[1:] != place[:-1]])]


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    """Of rows in order, whether none before is equal but for its place."""
    key = _mixed(rows["bytes"]) ^ (rows["first"].astype(np.uint64) << np.uint64(8)) ^ rows["last"]
    with np.errstate(over="ignore"):
        key = (key * MIX) ^ rows["hash"]
    _, at = np.unique(key, return_index=True)
    out = np.zeros(len(rows), bool)
    out[at] = True
    return out


def _covered(rows: np.ndarray) -> pa.RecordBatch:
    """All string starts of the rows as covered ranges."""
    return _ranges(rows["doc"], rows["tie"], rows["gram"] - rows["first"], rows["gram"] - rows["last"] + 1)


def _ranges(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, tie, start, end)], names=["doc", "tie", "from", "to"])


def repeated(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges of string starts in a bucket's stretches that have an equal string before them."""
    order = np.argsort(rows["hash"], kind="stable")
    h = rows["hash"][order]
    same = h[1:] == h[:-1]
    rows = _in_order(rows[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]])
    if not len(rows):
        return
    first = _first_of_each(rows)
    yield _covered(rows[~first])
    rows = rows[first]
    # a string holds the SIDE bytes before its gram or the SIDE bytes after it
    shares = np.zeros(len(rows), bool)
    for side, whole in ((rows["bytes"][:, SPAN - SIDE : SPAN], rows["first"] >= SIDE), (rows["bytes"][:, SPAN + GRAM : SPAN + GRAM + SIDE], SPAN - rows["last"] >= SIDE)):
        wide = np.zeros((len(rows), -(-SIDE // 8) * 8), np.uint8)
        wide[:, :SIDE] = side
        with np.errstate(over="ignore"):
            key = (_mixed(wide) * MIX) ^ rows["hash"]
        _, inverse, count = np.unique(key[whole], return_inverse=True, return_counts=True)
        shares[np.flatnonzero(whole)[count[inverse] > 1]] = True
    rows = rows[shares]
    if not len(rows):
        return
    strings = [b[SPAN - f : SPAN - t + LENGTH].astype(np.uint16) + 1 for b, f, t in zip(rows["bytes"], rows["first"].tolist(), rows["last"].tolist())]
    string, start, interval = bwt.shared_prefixes(strings, LENGTH)
    earliest = np.full(int(interval.max(initial=-1)) + 1, len(rows), np.int64)
    np.minimum.at(earliest, interval, string)  # rows are in order
    later = string > earliest[interval]
    string, start = string[later], start[later]
    order = np.lexsort((start, string))
    string, start = string[order], start[order]
    if len(string):
        new = np.concatenate([[True], (string[1:] != string[:-1]) | (start[1:] != start[:-1] + 1)])
        row, a = rows[string[new]], start[new]
        b = start[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])] + 1
        base = row["gram"] - row["first"]
        yield _ranges(row["doc"], row["tie"], base + a, base + b)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans, n_bytes, n_removed, n_spans, kept) for every row of (doc_id, text).

    ``spans`` are the removed byte ranges and ``kept`` the other bytes. Documents come in order
    of id, nulls first; different texts with one id in order of their hash; of equal rows the
    first stays. Null and empty texts, and those under LENGTH bytes, lose nothing; an empty
    table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("key", F.xxhash64("doc", "tie"))
    facts = checkpointed(rows.select("doc", "tie", "key", F.octet_length("text").alias("size")))
    buckets = max(1, -(-(facts.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))
    # of equal texts all but the first go whole
    least = facts.where(F.col("size") >= LENGTH).groupBy("tie", "size").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = checkpointed(facts.join(least, ["tie", "size"]).where("doc != least").select("doc", "tie", "key", F.lit(0).cast("long").alias("from"), (F.col("size") - LENGTH + 1).cast("long").alias("to")).distinct())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def signs_of(texts: list[bytes], keys: np.ndarray) -> np.ndarray:
            runs = Runs(texts)
            signs = np.empty(len(runs.hash), SIGN)
            signs["hash"], signs["key"] = runs.hash, keys[runs.owner]
            signs["left"], signs["right"] = runs.sides()
            signs, times = np.unique(signs[(signs["left"] > 0) | (signs["right"] > 0)], return_counts=True)
            return np.repeat(signs, np.minimum(times, 2))  # two tell of a repeat in one text

        yield from _dealt((signs_of(*x) for x in _together(batches, "key")), buckets)

    def wanted(bucket: pa.Table) -> pa.Table:
        signs = shared(_unpressed(bucket, SIGN))
        signs = signs[np.argsort(signs["key"], kind="stable")]
        keys, at = np.unique(signs["key"], return_index=True)
        blobs = [x.tobytes() for x in np.split(signs["hash"], at[1:])] if len(keys) else []
        return pa.table({"key": pa.array(keys, pa.int64()), "want": pa.array(blobs, pa.binary())})

    signs = rows.select("text", "key").where(F.octet_length("text") >= LENGTH).mapInArrow(sign, "bucket long, blob binary")
    wants = signs.groupBy("bucket").applyInArrow(wanted, "key long, want binary")
    wants = checkpointed(wants.groupBy("key").agg(F.collect_list("want").alias("want")).join(copies.select("key"), "key", "left_anti"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _together(batches, "doc", "tie", "want")
        found = (stretches(t, doc, tie, [np.frombuffer(b"".join(w), "<u4") for w in want]) for t, doc, tie, want in parts)
        yield from _dealt(map(_in_order, found), buckets)

    # the exchange of the texts by key serves this join and the last one
    pieces = rows.join(wants, "key").select("doc_id", "text", "doc", "tie", "want").mapInArrow(cut, "bucket long, blob binary")

    def search(bucket: pa.Table) -> pa.Table:
        kind = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])
        return pa.Table.from_batches(repeated(_unpressed(bucket, STRETCH)), kind)

    met = pieces.groupBy("bucket").applyInArrow(search, "doc long, tie long, `from` long, `to` long")
    covered = met.withColumn("key", F.xxhash64("doc", "tie")).select("key", "from", "to").union(copies.select("key", "from", "to"))
    covered = covered.groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("doc"))
    joined = rows.withColumn("nth", nth).join(covered, "key", "left").select("doc_id", "text", "nth", "ranges")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            text, nth, ranges = batch.column("text"), batch.column("nth").to_pylist(), batch.column("ranges")
            spans = [[]] * batch.num_rows
            some = np.flatnonzero((np.array(nth) > 1) | ranges.is_valid().to_numpy(zero_copy_only=False))
            rest = []
            for i in some.tolist():
                t = text[i].as_py()
                gone = _removed(t, nth[i], ranges[i].as_py())
                spans[i] = [{"start": a, "end": b} for a, b in gone]
                rest.append(_rest(t, gone))
            mask = np.zeros(batch.num_rows, bool)
            mask[some] = True
            kept = pc.replace_with_mask(text, pa.array(mask), pa.array(rest, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, pa.array(spans, span), kept], names=["doc_id", "text", "spans", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    out = joined.mapInArrow(take, f"doc_id {kind}, text binary, spans array<struct<start:bigint,end:bigint>>, kept binary")
    counts = (F.octet_length("text").cast("long"), (F.octet_length("text") - F.octet_length("kept")).cast("long"), F.size("spans").cast("long"))
    return out.select("doc_id", "text", "spans", "kept", *[c.alias(n) for c, n in zip(counts, ("n_bytes", "n_removed", "n_spans"))])


def _together(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Texts and the columns ``names``, for portions of about TOGETHER bytes."""
    texts, others, size = [], [[] for _ in names], 0
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        for i, t in enumerate(batch.column("text")):
            texts.append(t.as_py())
            for into, column in zip(others, columns):
                into.append(column[i])
            size += len(texts[-1])
            if size >= TOGETHER:
                yield texts, *[np.array(o) if n != "want" else o for n, o in zip(names, others)]
                texts, others, size = [], [[] for _ in names], 0
    if texts:
        yield texts, *[np.array(o) if n != "want" else o for n, o in zip(names, others)]


def _dealt(parts: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, blob): arrays cut up by bucket of their grams' hashes, DEALT bytes at a time."""
    press = zstandard.ZstdCompressor(level=1)

    def deal(found: np.ndarray) -> pa.RecordBatch:
        bucket = ((found["hash"].astype(np.uint64) * MIX) >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        ids, at = np.unique(bucket[order], return_index=True)
        blobs = [press.compress(found[x].tobytes()) for x in np.split(order, at[1:])] if len(ids) else []
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size >= DEALT:
            yield deal(np.concatenate(held))
            held, size = [], 0
    if held:
        yield deal(np.concatenate(held))


def _unpressed(bucket: pa.Table, kind: np.dtype) -> np.ndarray:
    unpress = zstandard.ZstdDecompressor()
    return np.concatenate([np.frombuffer(unpress.decompress(x.as_py()), kind) for x in bucket.column("blob")])


def _removed(text: bytes, nth: int, ranges: list | None) -> list[tuple[int, int]]:
    if nth > 1:
        return [(0, len(text))] if len(text) >= LENGTH else []
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["from"], r["to"] + LENGTH - 1) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


@query("op7_bwt_merge_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
