"""op11 to op13: main texts of pages, whitened embeddings, spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stormledger.llm.pages import main_texts
from stormledger.llm.registry import query, table
from stormledger.llm.spelling import noisy_words, variant_groups
from stormledger.llm.whitening import whiten


@query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(noisy_words(table(spark, sf_dir, "documents"), "doc_id"))


@query("op11_main_text")
def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
