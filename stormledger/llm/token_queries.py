"""op4, op6 and op8: token ids encoded and decoded, written to compressed blocks, packed."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.llm.bpe import encode_decode
from stormledger.llm.idfile import read_ids, write_ids
from stormledger.llm.packing import cut_documents, pack
from stormledger.llm.registry import query, table
from stormledger.session import work_folder

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
END_ID = 2


def packed_documents(documents: DataFrame) -> DataFrame:
    """A row per piece, with its place and the checksum of its ids."""
    cut = cut_documents(documents.select("doc_id", "text"), "text", public_tokenizers.path(WORD_BPE), "word", END_ID)
    return pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), ["doc_id", "start"]).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        "sequence_id", F.col("offset").cast("long").alias("offset"),
    )


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(documents, public_tokenizers.path(WORD_BPE)).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_id_files")
def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/ids-{uuid.uuid4().hex}"
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_ids(documents, "doc_id", folder, public_tokenizers.path(BYTE_BPE), "byte", END_ID)
    return read_ids(spark, folder).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"),
    )
