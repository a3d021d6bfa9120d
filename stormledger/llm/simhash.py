"""Near-duplicate groups: SimHash fingerprints of word shingles, linked at a small Hamming distance.

Pigeonhole: if two fingerprints differ in at most D bits, they agree on m - D of any m blocks. Each
distinct fingerprint is filed once per choice of m - D blocks under the bits of these blocks; the
filed rows are joined on (choice, bits) and every pair is verified by the bits in which it differs.
m follows the number of distinct fingerprints, so that a file holds few that are not close; the
links are the same for any m >= D + 1.

Equal fingerprints count once, whatever the number of documents behind them. A file with more than
CROWD fingerprints is not paired. Two fingerprints differ in at most D bits exactly if some third
value lies within D / 2 of both; its fingerprints are therefore filed under all values within D / 2
and linked to the smallest one there. That is exact too and linear in the file's size.

Groups are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormledger.llm.arrow import small_batches
from stormledger.operators.network import components
from stormledger.session import WorkTables

SHINGLE_WORDS, DISTANCE = 4, 4
SEED = 42
CROWD = 1024
SLACK_BITS = 2  # 2^bits of a file's key may fall so far short of the fingerprints' number
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint_of(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint: per bit, 1 if set in over half the shingles' hashes; 0 without words.

    Shingles, repeats included, are runs of shingle_words words of the text with A-Z lowered, joined
    by one space; a text with fewer words is one shingle. Hashes are XXH64 of UTF-8 with seed SEED.
    """
    import re

    import numpy as np
    from xxhash import xxh64_digest

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    short = max(0, len(words) - shingle_words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:short] + 1).tolist()]
    last = ends[min(shingle_words, len(words)) - 1:].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65_536):
        pairs = zip(starts[at:at + 65_536], last[at:at + 65_536])
        hashes = b"".join([xxh64_digest(joined[a:z], SEED) for a, z in pairs])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """df with `fingerprint`, a long that holds the 64 bits; a null text counts as empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts in batches:
            found = [fingerprint_of(t.as_py(), shingle_words) for t in texts]
            yield pa.array([f - (1 << 64) if f >> 63 else f for f in found], pa.int64())

    return df.withColumn("fingerprint", F.arrow_udf(run, T.LongType(), F.ArrowUDFType.SCALAR_ITER)(F.col(text)))


def blocks_for(distinct: int, distance: int = DISTANCE) -> int:
    """The fewest blocks whose keys tell so many fingerprints apart, up to SLACK_BITS."""
    need = max(1, distinct).bit_length() - SLACK_BITS
    return next((m for m in range(distance + 1, 4 * distance) if 64 // m * (m - distance) >= need), 4 * distance)


def masks_for(blocks: int, distance: int = DISTANCE) -> list[int]:
    """One mask of signed 64 bits per choice of blocks - distance blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    found = [sum(c) for c in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _flips(most: int) -> list[int]:
    """All signed 64-bit values with at most so many bits set."""
    found = [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(64), k)]
    return [f - (1 << 64) if f >> 63 else f for f in found]


def links(prints: DataFrame, distinct: int, work: WorkTables, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """(u, v): links between distinct fingerprints whose components are those of all close pairs.

    prints: fingerprint, each once.
    """
    masks = masks_for(blocks_for(distinct, distance), distance)
    choice = F.array(*[
        F.struct(F.lit(k).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)
    ])
    filed = prints.select("fingerprint", F.explode(choice).alias("f")).select("f.choice", "f.bits", "fingerprint")
    shared = filed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = work.save(filed.join(shared, ["choice", "bits"]))
    small = shared.filter(F.col("size") <= crowd)
    a = small.select("choice", "bits", F.col("fingerprint").alias("u"))
    b = small.select("choice", "bits", F.col("fingerprint").alias("v"))
    differing = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    close = a.join(b, ["choice", "bits"]).filter((F.col("u") < F.col("v")) & (differing <= distance)).select("u", "v")

    large = shared.filter(F.col("size") > crowd).select("fingerprint").distinct()
    flips = F.array(*[F.lit(x) for x in _flips(distance // 2)])
    within = large.select("fingerprint", F.explode(flips).alias("flip")).select(
        F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("value"), "fingerprint"
    )
    centre = within.groupBy("value").agg(F.min("fingerprint").alias("u"), F.max("fingerprint").alias("last")).filter("u < last")
    star = within.join(centre.select("value", "u"), "value").filter("u <> fingerprint").select("u", F.col("fingerprint").alias("v"))
    return close.union(star).distinct()


def near_groups(
    df: DataFrame, key: str, text: str = "text", distance: int = DISTANCE, shingle_words: int = SHINGLE_WORDS,
    slim: bool = False, work: WorkTables | None = None,
) -> DataFrame:
    """df (slim: without its text) with fingerprint, component_id and stays.

    component_id is the smallest `key` among the rows reachable over links; stays is true for
    exactly one row of a component, one that holds this key. Null keys are never the smallest while
    another exists. Null and empty texts share fingerprint 0 and are linked like any other;
    repeated rows fall into one component, of which one row stays. An empty table gives an empty
    one. Columns of the three names are replaced. The result reads the tables of `work`; who gives
    it may drop them when the result is stored.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    work = work or WorkTables(df.sparkSession, "simhash")
    kept = df.drop("fingerprint", "component_id", "stays")
    marked = with_fingerprint(kept, text, shingle_words)
    marked = marked.drop(text) if slim else marked
    with small_batches(df.sparkSession):
        rows = work.save(marked.withColumn("_row", F.monotonically_increasing_id()))
    best = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_row").alias("row")))
    prints, distinct = work.save_counting(
        rows.groupBy("fingerprint").agg(best.alias("best")).withColumn("_one", F.lit(True)), "_one",
    )
    prints = prints.drop("_one")
    comps = components(links(prints.select("fingerprint"), distinct, work, distance))
    labelled = prints.join(comps.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "best", F.coalesce("comp", "fingerprint").alias("comp")
    )
    first = labelled.groupBy("comp").agg(F.min("best").alias("first"))
    found = work.save(labelled.select("fingerprint", "comp").join(first, "comp").select("fingerprint", "first"))
    told = (rows if slim else rows.select("fingerprint", "_row")).join(found, "fingerprint").withColumns({
        "component_id": F.col("first.key"), "stays": F.col("first.row") == F.col("_row"),
    }).drop("first")
    # The many columns of a row travel by its number, spread evenly however common a fingerprint is.
    return told.drop("_row") if slim else rows.join(told.drop("fingerprint"), "_row").drop("_row")
