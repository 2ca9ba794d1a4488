"""Quality: a compression classifier with zstandard dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.labelled import Logistic, held_out, training_rows
from tollgate.llm.registry import query, table

#: Bytes compressed together: within them, little but the dictionary is there to refer to.
CHUNK = 1_024
#: The bounded sample of the fit: most labelled rows, and most chunks of them that a class gives to its
#: dictionary; dictionary bytes.
FIT_ROWS = 20_000
FIT_CHUNKS = 4_000
DICTIONARY = 64_000
LEVEL = 3


class Compressors:
    """Compressed bytes of whole texts, chunk by chunk, with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        kinds = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in (good, bad)]
        for k in kinds:
            k.precompute_compress(level=LEVEL)
        plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.two = [zstandard.ZstdCompressor(level=LEVEL, dict_data=k, **plain) for k in kinds]

    def features(self, text: bytes | None) -> list[float]:
        text = text or b""
        good = bad = 0
        for at in range(0, len(text), CHUNK):
            chunk = text[at : at + CHUNK]
            good += len(self.two[0].compress(chunk))
            bad += len(self.two[1].compress(chunk))
        if not text:
            return [0.0, 0.0, 0.0]
        gain = (bad - good) / (bad + good)
        return [gain, gain * abs(gain), good / len(text)]


class Model:
    def __init__(self, good: bytes, bad: bytes, logistic: Logistic | None = None):
        self.good, self.bad, self.logistic = good, bad, logistic

    def scores(self, texts: list[bytes | None], compressors: Compressors) -> np.ndarray:
        return self.logistic(np.array([compressors.features(t) for t in texts]).reshape(-1, 3))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Model:
    """Dictionaries from a bounded number of chunks of labelled rows that are not held out, one
    half of them; the scale of the score is fitted on the other half. Null labels, ids and texts
    teach nothing, equal chunks count once; without rows, or with one class, the score is the base rate."""
    rows = training_rows(docs, labels, label, most).select("doc_id", F.col("text").cast("binary").alias("text"), "label")
    half = F.pmod(F.xxhash64("text"), F.lit(2))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, mark in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_py()
                parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array([mark > 0] * len(parts), pa.bool_())], names=["part", "good"])

    parts = rows.where(half == 0).select("text", "label").mapInArrow(cut, "part binary, good boolean").distinct()
    texts = {}
    for good in (True, False):
        of = parts.where(F.col("good") == good).orderBy(F.xxhash64("part"), "part").limit(FIT_CHUNKS)
        texts[good] = [bytes(r.part) for r in of.select("part").collect()]
    model = Model(*[_dictionary(texts[g]) for g in (True, False)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = Compressors(model.good, model.bad)
        for batch in batches:
            x = [two.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int64())], names=["x", "label"])

    # at most FIT_ROWS rows of a few numbers
    got = rows.where(half == 1).select("text", "label").mapInArrow(measure, "x array<double>, label long").collect()
    model.logistic = Logistic(np.array([r.x for r in got]).reshape(-1, 3), np.array([r.label for r in got]))
    return model


def _dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary, or the raw text where there is too little to train on."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, parts)) // 8)), parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY] or b" " * 8


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``score`` of every row; null and empty texts score as texts that
    neither dictionary helps with; repeated rows and an empty table are ordinary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = Compressors(model.good, model.bad)
        for batch in batches:
            score = model.scores([t.as_py() for t in batch.column(0)], two)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], names=[*batch.schema.names[1:], "score"])

    chosen = docs.select(F.col("text").cast("binary").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]]
    return chosen.mapInArrow(run, ", ".join([*fields, "score double"]))


@query("op10_zstd_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model, "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
