"""Repeated passages: runs of consecutive sentences, hashed, joined over all documents, and removed.

A text is cut into sentences: pieces that end after . ! ? or a line break, and after the marks
, ; : that divide long ones, so that a passage put into the middle of a sentence shows its own
pieces. From each sentence on, the shortest run of at least RUN_SENTENCES sentences and RUN_WORDS
words is a span, which a 128-bit hash of its words (A-Z lowered, joined by one blank) stands for. The first occurrence of a span is
the one in the document with the smallest key and, there, the earliest. Sentences covered by any
other occurrence of a repeated span go; what is left keeps its characters and order.

Sentences without a word belong to no span and stay. Spans are counted and their first occurrences
found by one aggregation that combines before it shuffles, so a passage that a third of all
documents hold reaches it as one row per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import unpack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormledger.llm.arrow import add_columns
from stormledger.session import WorkTables

RUN_SENTENCES, RUN_WORDS = 2, 20
SENTENCE = re.compile(r"[^.!?,;:\n]+[.!?,;:\n]*|[.!?,;:\n]+")
WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPAN = "struct<first:int,last:int,h1:long,h2:long>"


def sentences(text: str | None) -> list[str]:
    """Pieces that together are the text."""
    return SENTENCE.findall(text or "")


def spans_of(text: str | None, run_sentences: int = RUN_SENTENCES, run_words: int = RUN_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, last sentence, 16-byte hash) per span; numbers count all sentences."""
    from xxhash import xxh3_128_digest

    numbers, said, sizes = [], [], []
    for k, sentence in enumerate(sentences((text or "").translate(LOWER))):
        words = WORD.findall(sentence)
        if words:
            numbers.append(k)
            said.append(" ".join(words))
            sizes.append(len(words))
    found = []
    last, words = 0, 0  # the run is numbers[i:last]
    for i in range(len(numbers)):
        while last < len(numbers) and (last - i < run_sentences or words < run_words):
            words += sizes[last]
            last += 1
        if last - i < run_sentences or words < run_words:
            break
        found.append((numbers[i], numbers[last - 1], xxh3_128_digest(" ".join(said[i:last]).encode())))
        words -= sizes[i]
    return found


def _with_spans(df: DataFrame, text: str, run_sentences: int, run_words: int) -> DataFrame:
    """df with _spans instead of its text: arrays of SPAN."""
    kind = T._parse_datatype_string(f"array<{SPAN}>")
    return add_columns(df, text, [T.StructField("_spans", kind)], lambda texts: [[
        [(a, z, *unpack("<2q", h)) for a, z, h in spans_of(t, run_sentences, run_words)] for t in texts
    ]]).drop(text)


def _without(text: str, gone: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the sentences of the ranges, and how many these are."""
    pieces = sentences(text)
    edge = [0] * (len(pieces) + 1)
    for a, z in gone:
        edge[a] += 1
        edge[z + 1] -= 1
    kept, depth = [], 0
    for piece, step in zip(pieces, edge):
        depth += step
        if not depth:
            kept.append(piece)
    return "".join(kept), len(pieces) - len(kept)


def remove_repeats(
    df: DataFrame, key: str, text: str = "text", run_sentences: int = RUN_SENTENCES, run_words: int = RUN_WORDS
) -> DataFrame:
    """df with `text` freed of repeated passages, and removed_sentences (long).

    Every row comes back, also one whose text is now empty. A null text stays null and an empty one
    empty, with 0 removed. A null key sorts before all others. Rows with equal keys and equal texts
    count as one document and lose the same; of other rows with equal keys, any one may count as
    the first. A column removed_sentences is replaced.
    """
    work = WorkTables(df.sparkSession, "spans")
    kept = df.drop("removed_sentences").withColumn("_text", F.xxhash64(text))
    documents = kept.select(F.col(key).alias("_key"), "_text", F.col(text).alias("_body"))
    documents = work.save(
        _with_spans(documents, "_body", run_sentences, run_words).withColumn("_row", F.monotonically_increasing_id())
    )
    spans = documents.select("_row", F.explode("_spans").alias("s")).select("_row", "s.*")
    # Half the hash tells which spans may come twice; only these need the rest, and their documents.
    twice = spans.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1")
    named = documents.select("_row", "_key", F.col("_text").alias("_same"))
    again = work.save(spans.join(twice, "h1").join(named, "_row").drop("_row"))
    work.keep_last()
    first = again.groupBy("h1", "h2").agg(F.min(F.struct("_key", "_same", "first")).alias("kept"))
    is_first = F.struct("_key", "_same", "first").eqNullSafe(F.col("kept"))
    gone = again.join(first, ["h1", "h2"]).filter(~is_first).groupBy("_key", "_same").agg(
        F.collect_set(F.struct("first", "last")).alias("_gone")
    )
    # Stored, its size is known: where few documents lose anything, no text is shuffled.
    gone = work.save(gone)
    work.keep_last()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = pa.struct([("text", pa.string()), ("n", pa.int64())])
        for texts, ranges in batches:
            out = []
            for body, gone in zip(texts, ranges):
                ranges_here = gone.as_py()
                out.append(ranges_here and dict(zip(("text", "n"), _without(body.as_py(), [(g["first"], g["last"]) for g in ranges_here]))))
            yield pa.array(out, made)

    cut = F.arrow_udf(run, "struct<text:string,n:long>", F.ArrowUDFType.SCALAR_ITER)
    of_row = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_text") == F.col("_same"))
    return kept.join(gone, of_row, "left").withColumn("_cut", cut(F.col(text), F.col("_gone"))).withColumns({
        text: F.when(F.col("_cut").isNull(), F.col(text)).otherwise(F.col("_cut.text")),
        "removed_sentences": F.coalesce("_cut.n", F.lit(0)).cast("long"),
    }).drop("_gone", "_key", "_same", "_text", "_cut")
