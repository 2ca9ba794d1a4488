"""Cross-tokenizer alignment: two vocabularies' tokens of one text, linked where they end together.

Texts are made distinct first, so each is tokenised and aligned once and counts with its number of
documents; what was measured goes back to the documents by a digest of the text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.registry import query, small_batches, table
from tollgate.llm.tokens import vocabulary
from tollgate.operators.keyed import attach
from tollgate.session import checkpointed

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Pattern by which the byte-level vocabulary's texts are cut before merging (fixed value).
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs of white space go to the slower library, whose pattern matching has no stack limit.
LONG_SPACE = 10_000
#: Rows in an Arrow batch with whole texts; pairs that a task counts before it hands them on.
TEXT_ROWS = 500
HELD_PAIRS = 2_000_000
#: Most id pairs whose counts go to all tasks; the links of the others meet their counts in a join.
HOT_PAIRS = 2**19


class ByteTokens:
    """Ids of space + text by a byte-level vocabulary file; special strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content["added_tokens"]}
        # the byte-level alphabet: printable bytes stand for themselves, the others are moved up in order
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        # merges are numbered in the order of their ranks, so the ids serve as ranks
        self.quick = tiktoken.Encoding("byte-level", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self.long_space = re.compile(rf"\s{{{LONG_SPACE}}}").search

    def __call__(self, text: str) -> list[int]:
        if len(text) >= LONG_SPACE and self.long_space(text):
            return self.whole.encode(" " + text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(" " + text)


class PieceTokens:
    """Ids of a text by a piece vocabulary file, which puts a space before it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.encode = model.encode

    def __call__(self, text: str) -> list[int]:
        return self.encode(text)


class Aligner:
    """Ids of both vocabularies and the places where tokens of both end."""

    def __init__(self, first: str, second: str):
        self.sides = [ByteTokens(first), PieceTokens(second)]
        self.lengths = [np.array([len(b) for b in side.bytes]) for side in self.sides]
        self.put = [[f"{i}{mark}".encode() for i in range(65_536)] for mark in ",|;"]
        if any(len(side.bytes) > 65_536 for side in self.sides):
            raise ValueError("ids need more than 16 bits")

    def __call__(self, text: str) -> tuple[int, int, np.ndarray, str] | None:
        """(tokens of A, tokens of B, links, digest of the groups); a link is the id of A times
        65 536 plus that of B. None if the tokens do not spell out the text."""
        wanted, ids = b" " + text.encode(), []
        for side in self.sides:
            ids.append(side(text))
            if b"".join(map(side.bytes.__getitem__, ids[-1])) != wanted:
                return None
        a, b = (np.array(x, np.int64) for x in ids)
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        ends = np.zeros(len(wanted) + 1, bool)
        ends[end_b] = True
        last_a = ends[end_a]
        ends[end_b] = False
        ends[end_a] = True
        last_b = ends[end_b]
        links = (a[last_a] << 16 | b[last_b]).astype("<u4")
        # a token's place in the listing: its own side's tokens before it, and the other's
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
        place_a = np.arange(len(a)) + upto_b[np.cumsum(last_a) - last_a]
        place_b = np.arange(len(b)) + upto_a[np.cumsum(last_b) - last_b]
        listed = np.empty(len(a) + len(b), np.int64)
        listed[place_a], listed[place_b] = a, b
        mark = np.zeros(len(listed), np.int64)
        mark[place_a[last_a]], mark[place_b[last_b]] = 1, 2
        listing = b"".join([self.put[m][i] for m, i in zip(mark.tolist(), listed.tolist())])
        return len(a), len(b), links, hashlib.sha256(listing[:-1]).hexdigest()


@lru_cache(1)
def aligner(first: str, second: str) -> Aligner:
    """One per Python worker."""
    return Aligner(first, second)


def aligned_texts(docs: DataFrame, first: str, second: str, text: str = "text") -> DataFrame:
    """One row per distinct non-empty text: (key, n_docs, n_a, n_b, links, groups_sha256)."""
    texts = docs.select(F.col(text).alias("text")).where("text != ''").groupBy("text").agg(F.count("*").alias("n_docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(first, second)
        for batch in batches:
            rows = [align(x.as_py()) or (0, 0, np.empty(0, "<u4"), "") for x in batch.column(0)]
            n_a, n_b, links, digests = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array([x.tobytes() for x in links], pa.binary()), pa.array(digests, pa.string())],
                names=["key", "n_docs", "n_a", "n_b", "links", "groups_sha256"],
            )

    with small_batches(docs.sparkSession, TEXT_ROWS):
        keyed = texts.select("text", _key(F.col("text")).alias("key"), "n_docs")
        return checkpointed(keyed.mapInArrow(run, "key binary, n_docs long, n_a long, n_b long, links binary, groups_sha256 string"))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many links of all documents an id pair stands, and whether no pair
    with its id of B stands in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        for batch in batches:
            links = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(0)]
            times = np.repeat(batch.column(1).to_numpy(), [len(x) for x in links])
            pairs, counts = _summed(np.concatenate([pairs, *links]), np.concatenate([counts, times]))
            if len(pairs) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    with small_batches(aligned.sparkSession, TEXT_ROWS):
        parts = aligned.select("links", "n_docs").mapInArrow(run, "pair long, n long")
        pairs = checkpointed(parts.groupBy("pair").agg(F.sum("n").alias("n")))
    other = F.col("pair").bitwiseAND(65_535).alias("b")
    # one row per id of B
    most = pairs.groupBy(other).agg(F.max("n").alias("most"))
    return checkpointed(pairs.withColumn("b", other).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint32(1)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _most_frequent(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, n, best) of at most ``most`` pairs: of the highest whole steps of a fourth of a
    doubling of the count that are no more together."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 4)
    lowest, held = None, 0
    for r in pairs.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > most:
            break
        lowest = r.step
    if lowest is None:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, bool)
    hot = pairs.where(step >= lowest).toArrow().combine_chunks()
    pair, n, best = (hot.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order].astype(np.uint32), n[order], best[order]


def measured_texts(aligned: DataFrame, pairs: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(key, n_docs, n_a, n_b, n_links, n_best, count_sum, groups_sha256) of ``aligned_texts``.

    Few pairs stand in most links. The counts of these, a bounded number, are looked up where the
    links are; the other links are joined with theirs, no such pair being frequent.
    """
    pair, n, best = _most_frequent(pairs, hot_pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(0):
                links = np.frombuffer(x.as_buffer(), "<u4")
                at = np.searchsorted(pair, links)
                known = at < len(pair)
                known[known] = pair[at[known]] == links[known]
                at = at[known]
                rows.append((len(links), int(best[at].sum()), int(n[at].sum()), links[~known].astype(np.int64)))
            n_links, n_best, total, rare = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(c, pa.int64()) for c in (n_links, n_best, total)), pa.array(rare, pa.list_(pa.int64()))],
                names=[*batch.schema.names[1:], "n_links", "n_best", "count_sum", "rare"],
            )

    with small_batches(aligned.sparkSession, TEXT_ROWS):
        first = aligned.select("links", "key", "n_docs", "n_a", "n_b", "groups_sha256").mapInArrow(
            run, "key binary, n_docs long, n_a long, n_b long, groups_sha256 string, n_links long, n_best long, count_sum long, rare array<long>"
        )
        first = checkpointed(first)
    rare = first.select("key", F.explode("rare").alias("pair")).join(pairs, "pair")
    rare = rare.groupBy("key").agg(F.count_if("best").alias("more_best"), F.sum("n").alias("more"))
    out = first.drop("rare").join(rare, "key", "left")
    return out.select(
        "key", "n_docs", "n_a", "n_b", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256"
    )


def aligned_documents(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    No token is empty, so every group of tokens ends in exactly one link. Null and empty texts, and
    texts that either side's tokens do not spell out byte by byte, have zeros and no digest.
    Documents with one text, also a third of all, share its row; repeated and null ids stay rows
    of their own; an empty table gives none.
    """
    aligned = aligned_texts(docs, first or vocabulary(BYTE_BPE), second or vocabulary(PIECE_BPE), text)
    facts = checkpointed(measured_texts(aligned, pair_counts(aligned)))
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text) != "", _key(F.col(text))).alias("key")))
    known = attach(rows.where("key is not null"), facts, "key", "n_docs").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256"
    )
    zero = F.lit(0).cast("long")
    rest = rows.where("key is null").select("doc_id", *[zero.alias(c) for c in known.columns[1:-1]], F.lit("").alias("groups_sha256"))
    return known.union(rest)


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"))
