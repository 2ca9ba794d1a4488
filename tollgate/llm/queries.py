"""All queries of this subpackage, and the pipeline's."""

import corpus_pipeline
from tollgate.llm import (  # noqa: F401
    alignment,
    compression,
    decontam,
    mixing,
    multiindex,
    nearest,
    packing,
    privacy,
    repeats,
    simhash,
    spelling,
    tokens,
    toxicity,
)
from tollgate.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
