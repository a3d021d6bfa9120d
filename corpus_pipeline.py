"""A training corpus from raw documents: cleaned, freed of near and partial copies, redacted, packed.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. run() writes the
result of each as Parquet in the shared work folder and reads it back for the next. All stages but
the last return the columns of documents; n_chars, where there is such a column, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.llm.jaccard import near_copies
from stormledger.llm.quality import clean_lines
from stormledger.llm.secrets import redact
from stormledger.llm.simhash import near_groups
from stormledger.llm.spans import remove_repeats
from stormledger.llm.token_queries import packed_documents
from stormledger.operators.joins import join_numbers
from stormledger.session import WorkTables, materialise


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, all else in one column, so that no name can clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*others).alias("_others"))


def _restored(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, n_chars counted anew."""

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.length("text").cast(docs.schema[name].dataType).alias(name)
        return F.col("_others").getField(name).alias(name)

    return changed.select(*[column(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail a rule."""
    kept = clean_lines(_carried(docs)).filter("kept").drop("text").withColumnRenamed("clean_text", "text")
    return _restored(docs, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group, the document with the smallest doc_id stays.

    Groups are those of op10_simhash; what they leave is then freed of texts that share 80 % of
    their five-word shingles, which mostly differ in more bits than op10's contract links.
    """
    rows = WorkTables(spark, "near-rows").save(_carried(docs).withColumn("_no", F.monotonically_increasing_id()))
    # The texts stay where they are stored; only the numbers of their rows travel.
    work, lost = WorkTables(spark, "simhash"), WorkTables(spark, "near-lost")
    groups = near_groups(rows.select("doc_id", "_no", "text"), "doc_id", slim=True, work=work)
    first = lost.save(groups.filter("not stays").select("_no"))
    work.drop()
    second = near_copies(rows, "_no", "doc_id", lost=first)
    return _restored(docs, join_numbers(rows, first.union(second), "_no", "left_anti", lost))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages seen before go; a document of which no word is left goes too."""
    left = remove_repeats(_carried(docs), "doc_id")
    gone = (F.col("removed_sentences") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _restored(docs, left.filter(~gone))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _restored(docs, redact(_carried(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence."""
    return packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

ORACLE_SQL = None  # SQL has neither the hash of the fingerprints nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
