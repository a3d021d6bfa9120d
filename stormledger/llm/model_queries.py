"""op2: every document scored by a model that has not seen a fifth of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.llm.maxent import score_texts
from stormledger.llm.registry import query, table


@query("op2_maxent")
def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return score_texts(table(spark, sf_dir, "documents"), "doc_id", held_out).withColumnRenamed("key", "doc_id")
