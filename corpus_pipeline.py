"""From raw documents to token shards: toxicity, near-duplicates, benchmark leaks, mix, tokens.

Every stage takes the documents its predecessor kept, whole, and all but the last return the
columns of ``documents``. A stage's result is written as Parquet and read again, so a lost
executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import decontam, mixing, near_copies, tokens, toxicity
from tollgate.llm.registry import table
from tollgate.session import checkpointed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the labels are learnt on this input.

    Null and empty texts score like any clean text; repeated rows go or stay together; without
    labels of both classes nothing goes unless most labelled documents are toxic.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = toxicity.scored(docs.select(row, "text"), model, "row")
    return scored.where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose five-word shingles are alike by 0.8 or more: the smallest
    id, null ids last. Texts without words, null ones included, are one group."""
    return near_copies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, closely or exactly; null and empty texts hold none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes: a document twice, once, in part or not at all. Texts without
    words have nothing to take; a null source is a source; equal rows are told apart by place."""
    return mixing.mixed_texts(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder, and (doc_id, start, n_tokens, ids_crc32) read from them, a
    row per document; null and empty texts hold the end id alone, null ids come first."""
    return tokens.token_output(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mix", mix),
    ("token_output", write_tokens),
]

#: SQL cannot fit the model, search by Hamming distance or encode tokens; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
