"""Loads the modules that register the subpackage's queries."""

import corpus_pipeline

from stormledger.llm import cleanup_queries, index_queries, model_queries, native_queries, text_queries, token_queries
from stormledger.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run

__all__ = [
    "ORACLES", "QUERIES", "cleanup_queries", "index_queries", "model_queries", "native_queries", "text_queries", "token_queries",
]
