"""Near copies by content: texts whose sets of word shingles overlap by a least share.

Candidates come from MinHash bands: texts of Jaccard similarity s share one of BANDS buckets with
probability 1 - (1 - s^ROWS)^BANDS, 99.99 % at 0.8. Every candidate pair is then verified on the
hashes of the shingles, so no pair below the limit is linked. Groups are the connected components of
the links; of each, the row that comes first stays.

A bucket is not paired as a whole. In rounds, each bucket names one leader, the smallest text in it
that is near no earlier leader, and all others are verified against it: a round makes at most one
pair per text and bucket. A bucket is done when each text was a leader or is near one, so a large
group of near copies costs its size, not its square, and one round.

Buckets that are not done after OPEN_ROUNDS hold many unlike texts, such as those that share a long
passage, or surround a group of near copies at a similarity below the limit. Their texts are settled
exactly and without pairing members of one group (`across`). Write q for (100 - least) / (100 + least):
two sets of sizes n and m are near if and only if they differ in at most q * (n + m) shingles.

* Which groups a text meets. With shingles in one order for all texts, the rarest first, two near sets
  have a first common shingle, at places i and k, and i + k <= q * (n + m). Groups meet by the best
  place of their members; a passage that many share lies too far back in the order.
* Whether it is near a member of a group it meets. It is verified against the group's head first. If
  that fails, all sets are replaced by their differences from the head, in which what the group has in
  common cancels out and the distance of two sets stays as it was. A near member then shares more than
  (1 - q) / 2 of its difference with the text's, so one shingle of the rarer part of it at least.
  Only such pairs are verified.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormledger.llm.arrow import add_columns, small_batches
from stormledger.llm.simhash import LOWER, SEED
from stormledger.operators.joins import join_numbers
from stormledger.operators.network import components
from stormledger.session import WorkTables

SHINGLE_WORDS, LEAST_PCT = 5, 80
BANDS, ROWS = 24, 5
OPEN_ROUNDS = 4  # leaders of a bucket before its texts are settled by groups
DEALT = 64  # parts over which the pairs of one leader, or the texts with one shingle, are dealt
HASHED_AT_ONCE = 2048  # bounds the table of hash values of a long text
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> set[bytes]:
    """Runs of words, A-Z lowered and joined by one blank; a text with fewer words is one shingle."""
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return set()
    return {b" ".join(words[i:i + shingle_words]) for i in range(max(1, len(words) - shingle_words + 1))}


def hashed(found: set[bytes]):
    """The shingles' XXH64 as signed 64-bit integers, each once."""
    import numpy as np
    from xxhash import xxh64_digest

    return np.unique(np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in found]), ">i8").astype(np.int64))


def _hash_functions():
    """Factors and offsets of the BANDS * ROWS functions, the same in every worker."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def buckets(found: set[bytes]) -> list[int]:
    """One signed 64-bit bucket per band; none without shingles."""
    import numpy as np
    from xxhash import xxh64_digest, xxh64_intdigest

    if not found:
        return []
    factors, offsets = _hash_functions()
    hashes = np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in found]), np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), HASHED_AT_ONCE):
        values = factors[:, None] * hashes[at:at + HASHED_AT_ONCE]
        values += offsets[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    least >>= np.uint64(8)
    keys = [xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _both(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """pairs (u, v, ..) with n_u and n_v, the sizes, and a and b, the hashes of both. u may be in many pairs."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(DEALT)))
    left = prints.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("hashes").alias("a"))
    right = prints.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("hashes").alias("b"))
    heads = dealt.select("u", "part").distinct().join(left, "u")
    return dealt.join(right, "v").join(heads, ["u", "part"]).drop("part")


def _verified(pairs: DataFrame, prints: DataFrame, least_pct: int = LEAST_PCT) -> DataFrame:
    """pairs (u, v), each once, whose sets overlap by least_pct hundredths. prints: node, n, hashes."""
    both = F.size(F.array_intersect("a", "b"))
    alike = (100 * F.least("n_u", "n_v") >= least_pct * F.greatest("n_u", "n_v")) & (
        100 * both >= least_pct * (F.col("n_u") + F.col("n_v") - both)
    )
    return _both(pairs, prints).filter(alike).select("u", "v")


def _placed(held: DataFrame, counts: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """texts columns and, in `placed`, struct(h, at): places of a text's shingles, the rarest first.

    held: texts, n_held (shingles of the text), h, part (a text's share of a crowded shingle), and
    counts: keys and part, c. Shingles of which counts has none come first and are left out.
    """
    total = counts.groupBy(*keys).agg(F.sum("c").alias("times"))
    told = held.join(counts.select(*keys, "part").join(total, keys), [*keys, "part"])
    ordered = told.groupBy(*texts, "n_held").agg(F.sort_array(F.collect_list(F.struct("times", "h"))).alias("shared"))
    # a row holds one text's shingles
    before = F.col("n_held") - F.size("shared")
    return ordered.withColumn("placed", F.transform("shared", lambda x, i: F.struct(
        x["h"].alias("h"), x["times"].alias("times"), (before + i).alias("at"),
    ))).drop("shared", "n_held")


def _part(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(DEALT)).alias("part")


def _rarest(prints: DataFrame, work: WorkTables, least_pct: int = LEAST_PCT) -> DataFrame:
    """(h, node, at): each text under those of its shingles of which a near one must hold one, with their places.

    Shingles that no other text holds are the rarest and lead nowhere; they only fill their places.
    """
    held = work.save(prints.select("node", F.col("n").alias("n_held"), F.explode("hashes").alias("h"), _part("node")))
    placed = _placed(held, held.groupBy("h", "part").agg(F.count(F.lit(1)).alias("c")), ["h"], ["node"])
    n = prints.select("node", "n")
    return placed.join(n, "node").select("node", "n", F.explode("placed").alias("x")).filter(
        (F.col("x.times") > 1) & (F.col("x.at") <= F.col("n") - F.ceil(least_pct * F.col("n") / 100))
    ).select("x.h", "node", "n", "x.at")


def _groups_met(rare: DataFrame, groups: DataFrame, work: WorkTables, least_pct: int = LEAST_PCT) -> DataFrame:
    """(node, head, many), each once: texts and the heads of groups, not their own, that may hold a near text.

    groups: node, head, size. Of two groups the larger is the host, whose head is given with the
    other's texts; many tells a host of more than one text.
    """
    over = (100 + least_pct) * F.col("at") - (100 - least_pct) * F.col("n")  # two near texts: their sum is 0 or less
    entries = work.save(rare.join(groups, "node").select("h", "node", "head", "size", over.alias("over")))
    hosts = entries.groupBy("h", "head", "size").agg(F.min("over").alias("host_over")).select(
        "h", F.col("head").alias("host"), F.col("size").alias("host_size"), "host_over",
    )
    larger = F.struct("host_size", "host") > F.struct("size", "head")

    def met(texts: DataFrame, in_list: DataFrame) -> DataFrame:
        found = texts.join(in_list, "h").filter(larger & (F.col("over") + F.col("host_over") <= 0))
        return found.select("node", F.col("host").alias("head"), (F.col("host_size") > 1).alias("many"))

    # One of the two lies at 0 or less, so texts beyond it never meet each other.
    near = met(entries, hosts.filter("host_over <= 0")).union(met(entries.filter("over <= 0"), hosts.filter("host_over > 0")))
    return near.distinct()


def _by_difference(guests: DataFrame, members: DataFrame, prints: DataFrame, work: WorkTables, least_pct: int = LEAST_PCT) -> DataFrame:
    """(u, v): pairs of a guest and a member that may be near, where no guest is near its head.

    guests, members: head, node; members without the heads themselves.
    """
    apart, alike = 100 - least_pct, 100 + least_pct
    pairs = members.withColumn("member", F.lit(True)).union(guests.withColumn("member", F.lit(False)))
    differing = F.concat(F.array_except("a", "b"), F.array_except("b", "a"))
    found = _both(pairs.withColumnsRenamed({"head": "u", "node": "v"}), prints).select(
        F.col("u").alias("head"), F.col("v").alias("node"), "member", F.col("n_u").alias("n_head"), F.col("n_v").alias("n"),
        differing.alias("diff"),
    )
    texts = ["head", "node", "member", "n_head", "n", "m"]
    held = work.save(found.withColumn("m", F.size("diff")).select(
        *texts, F.col("m").alias("n_held"), F.explode("diff").alias("h"), _part("node"),
    ))
    counts = held.groupBy("head", "h", "part").agg(F.count_if("member").alias("c"))
    placed = _placed(held, counts, ["head", "h"], texts).select(*texts, F.explode("placed").alias("x")).filter("x.times > 0")
    left = F.col("m") - F.col("x.at")  # the most that the two differences share from this place on
    enough = F.when(F.col("member"), alike * left >= least_pct * F.col("m")).otherwise(
        2 * alike * left >= alike * F.col("m") - apart * (F.col("n") + F.col("n_head"))
    )
    filed = work.save(placed.filter(enough).select("head", "x.h", "member", "node", "n", "m", left.alias("left")))

    def side(member: bool, mark: str) -> DataFrame:
        return filed.filter(F.col("member") == member).select(
            "head", "h", *[F.col(c).alias(f"{c}_{mark}") for c in ("node", "n", "m", "left")],
        )

    needed = alike * (F.col("m_a") + F.col("m_b")) - apart * (F.col("n_a") + F.col("n_b"))
    return side(True, "a").join(side(False, "b"), ["head", "h"]).filter(
        2 * alike * F.least("left_a", "left_b") >= needed
    ).select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct()


class _Rounds:
    """Links between texts that share a bucket, gathered over several filings."""

    PAIR = "u long, v long"

    def __init__(self, prints: DataFrame, work: WorkTables) -> None:
        self.prints, self.work = prints, work
        self.tried: list[str] = []
        self.near: list[str] = []

    def links(self) -> DataFrame:
        return self.work.union(self.near, self.PAIR)

    def _verify(self, pairs: DataFrame) -> None:
        """Verifies pairs (u, v), each once, that were not tried before."""
        if self.tried:
            pairs = pairs.join(self.work.union(self.tried, self.PAIR), ["u", "v"], "left_anti")
        pairs = self.work.save(pairs)
        self.tried.append(self.work.paths[-1])
        self.work.save(_verified(pairs, self.prints))
        self.near.append(self.work.paths[-1])

    def run(self, filed: DataFrame, most: int) -> DataFrame:
        """Rounds over filed (bucket, node) until all buckets are done, or so many. Gives the texts of the others."""
        work = self.work
        members, rounds = work.save(filed.withColumn("open", F.lit(True))), 0
        while True:
            leaders = work.save(members.filter("open").groupBy("bucket").agg(F.min("node").alias("leader")))
            met = work.save(members.join(leaders, "bucket").filter("node <> leader").select(
                "bucket", "node", "open", F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v"),
            ))
            self._verify(met.select("u", "v").distinct())
            told = met.join(self.links().withColumn("near", F.lit(True)), ["u", "v"], "left").select(
                "bucket", "node", (F.col("open") & F.col("near").isNull()).alias("open"),
            )
            members, n = work.save_counting(told, "open")
            rounds += 1
            if not n or rounds == most:
                undone = members.filter("open").select("bucket").distinct()
                return members.join(undone, "bucket", "left_semi").select("node").distinct()

    def across(self, crowd: DataFrame) -> None:
        """Adds links, so that all near texts of crowd (node) are in one group of the links."""
        work = self.work
        prints = work.save(self.prints.join(crowd, "node", "left_semi"))
        comps = components(self.links())
        grouped = prints.select("node").join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
        grouped = work.save(grouped)
        sizes = grouped.groupBy("comp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size"))
        groups = work.save(grouped.join(sizes, "comp").select("node", "head", "size"))
        met = work.save(_groups_met(_rarest(prints, work), groups, work))
        ends = [F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v")]
        self._verify(met.select(*ends))
        guests = met.filter("many").select("head", "node", *ends).join(self.links(), ["u", "v"], "left_anti").select("head", "node")
        guests = work.save(guests)
        hosts = guests.select("head").distinct()
        members = groups.filter("node <> head").join(hosts, "head", "left_semi").select("head", "node")
        self._verify(_by_difference(guests, members, prints, work))


def without_near_copies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df without the rows whose group, linked by near texts, holds a row with a smaller key.

    Null keys come after all others, ties in any order. Null and empty texts, and those of blanks,
    have no shingle and stay, repeated or not; repeated rows with words are near and one stays.
    Texts of any length are taken whole. An empty table gives an empty one; all columns are kept.
    """
    rows = WorkTables(df.sparkSession, "jaccard-rows").save(df.withColumn("_row", F.monotonically_increasing_id()))
    work = WorkTables(df.sparkSession, "jaccard-lost")
    return join_numbers(rows, near_copies(rows, "_row", key, text), "_row", "left_anti", work).drop("_row")


def near_copies(rows: DataFrame, row: str, key: str, text: str = "text", lost: DataFrame | None = None) -> DataFrame:
    """The numbers of the rows that without_near_copies leaves out, in a stored column `row`.

    rows: a stored table; row: its column of distinct longs. Rows named in `lost` (row) count as absent.
    """
    spark = rows.sparkSession
    work = WorkTables(spark, "jaccard")
    signed = add_columns(
        rows.select(F.col(row).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_body")), "_body",
        [T.StructField("buckets", T.ArrayType(T.LongType()))], lambda texts: [[buckets(shingles(t)) for t in texts]],
        drop_text=True,
    )
    with small_batches(spark):
        signed = work.save(signed)
    if lost is not None:
        signed = signed.join(lost.select(F.col(row).alias("_row")), "_row", "left_anti")
    # Numbers that follow the keys' order, so that a smaller node is a row that goes before.
    nodes = work.save(signed.orderBy(F.col("_key").asc_nulls_last(), "_row").select(
        F.monotonically_increasing_id().alias("node"), "_row", "buckets",
    ))
    filed = nodes.select(F.explode("buckets").alias("bucket"), "node")
    shared = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = work.save(filed.join(shared, "bucket"))
    used = members.select("node").distinct().join(nodes.select("node", "_row"), "node")
    bodies = join_numbers(rows.select(F.col(row).alias("_row"), F.col(text).alias("body")), used, "_row", "inner", work)
    prints = add_columns(
        bodies.select("node", "body"), "body", [T.StructField("hashes", T.ArrayType(T.LongType()))],
        lambda texts: [[hashed(shingles(t)) for t in texts]], drop_text=True,
    )
    with small_batches(spark):
        prints = work.save(prints.select("node", F.size("hashes").alias("n"), "hashes"))

    rounds = _Rounds(prints, work)
    crowd, many = work.save_counting(rounds.run(members, OPEN_ROUNDS).withColumn("_one", F.lit(True)), "_one")
    if many:
        rounds.across(crowd.select("node"))
    gone = components(rounds.links()).filter("comp < node").select("node")
    found = work.save(nodes.join(gone, "node", "left_semi").select(F.col("_row").alias(row)))
    work.keep_last()
    return found
