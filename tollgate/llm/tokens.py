"""Token ids in binary shards: encode, write one wavelet-matrix file per shard, read back."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import wavelet
from tollgate.llm.registry import query, small_batches, table
from tollgate.operators.ordered import running_totals
from tollgate.session import checkpointed, shared_folder

END_ID = 2
#: Text bytes meant for one shard.
SHARD_BYTES = 8_000_000
#: Texts encoded together, and shards whose tokens are summed in one group.
TOGETHER = 50
SLAB = 4_096
#: Ends a text among texts that are encoded together, and the id that stands for it.
BREAK, BREAK_ID = "\x7f", 65_535
SPACE, LETTER, DIGIT, MARK = range(1, 5)


def _kinds() -> np.ndarray:
    """What a Latin-1 character of a plain, lower-cased text is; 0 for the break."""
    kind = np.zeros(256, np.uint8)
    kind[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
    kind[[b for b in range(0x21, 0x7F) if not chr(b).isalpha()]] = MARK
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[ord("a") : ord("z") + 1] = LETTER
    kind[0xDF:0xFF] = LETTER
    kind[0xF7] = 0  # the division sign is in no plain text
    return kind


def _finals() -> np.ndarray:
    """The character that stands for another one at the end of a piece: capital letters, which a
    lower-cased text has not, and control characters for marks, once white space is gone."""
    final = np.arange(256, dtype=np.uint8)
    kind = _kinds()
    marks = np.flatnonzero(kind == MARK)
    final[marks] = np.arange(len(marks))
    letters = np.flatnonzero(kind == LETTER)
    final[letters] -= 0x20
    final[0xDF] = 0xD7  # the sharp s has no capital; the multiplication sign is in no plain text
    return final


class Encoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` as uint16 ids.

    The vocabulary lower-cases a text, cuts it into pieces, drops white space and merges each piece,
    the end of a piece being part of its last symbol. In plain texts (ASCII and Latin-1 letters)
    every symbol, last or not, can be written as a byte of its own, so that the merges of many
    texts at once are those of a byte-level vocabulary with the same ranks; no id depends on how
    texts are put together. All other texts go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        if max(vocab.values()) >= BREAK_ID:
            raise ValueError("ids need more than 16 bits")
        self.kind, self.final = _kinds(), _finals()
        self.plain = re.compile("[\\t\\n\\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xfe\xdf]*").fullmatch
        self.quick = tiktoken.Encoding(
            "pieces", pat_str=rf"{BREAK}|[^\x00-\x1f0-9A-ZÀ-Þ{BREAK}]*[\x00-\x1f0-9A-ZÀ-Þ]", mergeable_ranks={**self._ranks(vocab), BREAK.encode(): BREAK_ID}, special_tokens={}
        )

    def _ranks(self, vocab: dict[str, int]) -> dict[bytes, int]:
        """Ids, which are in the order of the merges, by the bytes that stand for a token."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        lead = 0xC3  # of every plain letter beyond ASCII; its second byte ends like the letter itself
        inner = {b: b for b in range(256) if self.kind[b] in (LETTER, MARK) and b < 0x80} | {lead: lead}
        inner |= {b & 0xBF: b & 0xBF for b in range(256) if self.kind[b] == LETTER and b >= 0x80}
        last = {b: int(self.final[b]) for b in range(256) if self.kind[b] in (LETTER, MARK, DIGIT) and b < 0x80}
        last |= {b & 0xBF: int(self.final[b]) & 0xBF for b in range(256) if self.kind[b] == LETTER and b >= 0x80}
        ranks = {}
        for token, i in vocab.items():
            ends = token.endswith("</w>")
            spelt = [byte_of.get(c, -1) for c in (token[:-4] if ends else token)]
            places = [inner] * (len(spelt) - ends) + [last] * ends
            if spelt and all(b in place for b, place in zip(spelt, places)):
                ranks[bytes(place[b] for b, place in zip(spelt, places))] = i
        return ranks

    def _marked(self, texts: list[str]) -> str:
        """The texts without white space, the last character of every piece by its stand-in."""
        c = np.frombuffer((BREAK.join(texts) + BREAK).lower().encode("latin-1"), np.uint8)
        kind = self.kind[c]
        after = np.append(kind[1:], 0)
        end = (kind == DIGIT) | ((kind != after) & (kind >= LETTER))
        # an apostrophe that begins a piece takes s, t, m, d, re, ve or ll along
        at = np.flatnonzero((c == ord("'")) & (np.append(0, kind[:-1]) != MARK) & (after == LETTER))
        one, two = c[at + 1], c[np.minimum(at + 2, len(c) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (one == ord(x)) & (two == ord(y))
        end[at[short | long]] = False
        end[at[short] + 1] = True
        end[at[long] + 2] = True
        return np.where(end, self.final[c], c)[kind != SPACE].tobytes().decode("latin-1")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [x if self.plain(x) and "<|" not in x else None for x in texts]
        ids = np.array(self.quick.encode_ordinary(self._marked([x or "" for x in plain])), "<u2")
        ends = np.flatnonzero(ids == BREAK_ID)
        out = [ids[a:b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())]
        return [o if p is not None else np.array(self.whole.encode(x, add_special_tokens=False).ids, "<u2") for x, p, o in zip(texts, plain, out)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the documents' ids in ascending order of their id and return the manifest:
    (shard, path, n_docs, n_tokens), one row per non-empty shard, in order of shard.

    Rows are range-partitioned by (id, hash of the text), so one id that repeats is split as
    well; equal ids are in order of that hash, then of the text, null ids come first. A file is
    written under a name of its own and moved into place, so a repeated task replaces it whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("mixed", F.xxhash64("text"))
    rows = rows.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id", "mixed").sortWithinPartitions("doc_id", "mixed", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ids, lengths, data = encoder(tokenizer), [], [], []
        end = np.array([end_id], "<u2")
        for batch in batches:
            ids += batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, TOGETHER):
                for got in encode(batch.column(1).slice(at, TOGETHER).to_pylist()):
                    lengths.append(len(got) + 1)
                    data += [got, end]
        if not ids:
            return
        shard = TaskContext.get().partitionId()
        content = wavelet.pack(ids, np.array(lengths), np.concatenate(data))
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        path, draft = f"{base}/shard-{shard:08d}.wm", f"{base}/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(content)
        store.move(draft, path)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([os.path.basename(path)]), pa.array([len(ids)], pa.int64()), pa.array([sum(lengths)], pa.int64())],
            names=["shard", "path", "n_docs", "n_tokens"],
        )

    # a worker holds a shard's ids besides a batch of texts, so batches are kept small
    with small_batches(docs.sparkSession, 500):
        return checkpointed(rows.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone but for the
    shards' starting places: running sums of the manifest, joined by shard."""
    shards = running_totals(manifest, "shard", {"n": F.sum("n_tokens")}, slab=F.floor(F.col("shard") / SLAB))
    starts = checkpointed(shards.select("shard", (F.col("n_upto") - F.col("n")).alias("before")))
    names = ["shard", "doc_id", "within", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                shard = int(path.as_py().rpartition("-")[2].split(".")[0])
                ids, lengths, matrix = wavelet.unpack(content.as_buffer())
                tokens = matrix.decode()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(tokens[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [np.full(len(lengths), shard), pa.array(ids, pa.int64()), ends - lengths, lengths, pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    if starts.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(folder).select("path", "content")
    found = files.mapInArrow(run, ", ".join(f"{n} long" for n in names)).join(starts, "shard")
    return found.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents as token shards in the shared folder and describe them from there.

    Null and empty texts hold the end id alone; repeated rows are written again; an empty table
    writes no shard and returns no rows.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_shards(docs, folder, tokenizer or vocabulary(), end_id)
    return read_shards(spark, folder, manifest)


@query("op2_wavelet_tokens")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
