"""Spelling variants: each word's neighbours at one edit, by bitsets per (position, letter).

Filing. Two words at one edit, the shorter of s letters, agree on all but the place of the edit. The
places 0..s are a segment; it is halved at `mid`: either both words share their first `mid` letters,
and the edit lies in the second half, or it lies in the first half and they share their last
s - mid. So a word of m letters is filed for s = m and s = m - 1, in two files each, under the
letters that words of a file share. A file of more than CROWD words is halved again, until it is
small or its segment is one place, which bounds it by the alphabet. A pair counts in one file only:
where both halves would hold it, in the second.

Index. Files are dealt to buckets of about BUCKET words. For a position p and a letter c a bitset
tells which words of the bucket have c at p. All queries of a bucket run over the positions in step,
a query a row of bits: `same` holds the words that equal the query so far; `swapped`, `longer` and
`shorter` those that do with one letter replaced, inserted and deleted, of which the last two read
the bitsets of the position beside. At the end a mask per file leaves the words of the query's own.

A bucket returns a count and the best neighbour per query, never its pairs, so that the rows moved
follow the words. Words are never dropped, however long or common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.session import WorkTables

CROWD, BUCKET = 8192, 4096
QUERIES = 512  # rows of bits held at once
MIN_LETTERS, MIN_TIMES, RATIO = 7, 2, 10
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "word string, n_near long, near_n long, near string"


def _halves(s: Column, lo: Column, hi: Column) -> Column:
    mid = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(s.alias("s"), mid.alias("lo"), hi.alias("hi")), F.struct(s.alias("s"), lo.alias("lo"), mid.alias("hi")))


def _filed(segments: DataFrame) -> DataFrame:
    """word, n, s, lo, hi with the letters shared in the file: lo at the start, s - hi at the end."""
    tail = F.col("s") - F.col("hi")
    return segments.filter("hi > 0").withColumns({
        "head": F.substring("word", F.lit(1), F.col("lo")),
        "tail": F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise(""),
    })


def _bits(flags):
    """Boolean rows as rows of 64-bit numbers."""
    import numpy as np

    packed = np.packbits(flags, axis=-1, bitorder="little")
    width = -(-packed.shape[-1] // 8) * 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, width - packed.shape[-1])]).view(np.uint64)


def bucket_neighbours(words: list[str], s: int, files, excluded):
    """(query, word) index arrays: the pairs at one edit whose shorter word has s letters.

    words have s or s + 1 letters; files numbers the file of each. Pairs that share their first
    excluded[query] letters are left out (0: none is).
    """
    import numpy as np

    n = len(words)
    letters = np.zeros((n, s + 2), np.int64)  # 0: no letter at this position
    long = np.fromiter((len(w) > s for w in words), bool, n)
    for length in (s, s + 1):
        own = np.flatnonzero(long == (length > s))
        if len(own):
            flat = np.frombuffer("".join(words[k] for k in own).encode("utf-32-le"), np.uint32)
            letters[own, :length] = flat.reshape(-1, length).astype(np.int64) + 1
    letters = np.unique(letters, return_inverse=True)[1].reshape(n, s + 2)
    codes = np.arange(letters.max() + 1)[:, None]

    def having(p: int):
        """Row c: the words with letter c at position p."""
        held = _bits(letters[None, :, p] == codes)
        held[0] = 0
        return held

    number = np.unique(files, return_inverse=True)[1].reshape(n)
    of_length = {False: _bits(~long[None])[0], True: _bits(long[None])[0]}
    queries, found = [], []
    for is_long in (False, True):
        own = np.flatnonzero(long == is_long)
        if not len(own) or (is_long and not (~long).any()):
            continue
        parts = [own[at:at + QUERIES] for at in range(0, len(own), QUERIES)]
        everyone = _bits(np.ones((1, n), bool))[0]
        state = [{"same": np.tile(everyone, (len(q), 1)), "barred": np.zeros((len(q), len(everyone)), np.uint64)} for q in parts]
        for x, q in zip(state, parts):
            x["edited"] = np.zeros_like(x["barred"])
            if not is_long:
                x["longer"] = np.zeros_like(x["barred"])
        before, here = None, having(0)
        for p in range(s + is_long):
            after = having(p + 1)
            for x, q in zip(state, parts):
                same, asked = x["same"], letters[q, p]
                equal = here[asked]
                if is_long:  # of the query one letter is deleted: from then on it is one ahead
                    x["edited"] = (x["edited"] & before[asked] | same) if p else same.copy()
                else:
                    x["edited"] = x["edited"] & equal | same & ~equal
                    x["longer"] = (x["longer"] | same) & after[asked]
                x["same"] = same & equal
                at_bar = excluded[q] == p + 1
                x["barred"][at_bar] = x["same"][at_bar]
            before, here = here, after
        for x, q in zip(state, parts):
            hits = x["edited"] & of_length[False]
            if not is_long:
                hits |= (x["longer"] | x["same"]) & of_length[True]
            hits &= ~x["barred"]
            rows = np.flatnonzero(hits.any(axis=1))
            flags = np.unpackbits(hits[rows].view(np.uint8), axis=1, bitorder="little")
            r, w = np.nonzero(flags[:, :n])
            r = q[rows[r]]
            alike = number[r] == number[w]
            queries.append(r[alike])
            found.append(w[alike])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *queries]), np.concatenate([none, *found])


def _search(bucket):
    """A bucket's filed words (one s): per query, how many neighbours and the one of largest n."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    words, n = bucket.column("word").to_pylist(), bucket.column("n").to_numpy()
    s, lo, hi = bucket.column("s")[0].as_py(), bucket.column("lo").to_numpy(), bucket.column("hi").to_numpy()
    tags = zip(lo.tolist(), hi.tolist(), bucket.column("head").to_pylist(), bucket.column("tail").to_pylist())
    numbers: dict[tuple, int] = {}
    files = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tags), np.int64, len(words))
    query, near = bucket_neighbours(words, s, files, np.where(hi < s, hi, 0))
    order = np.argsort(pc.sort_indices(bucket.column("word")).to_numpy(), kind="stable")  # places in code-point order
    best_first = np.lexsort((order[near], -n[near], query))
    query, near = query[best_first], near[best_first]
    asked, first, times = np.unique(query, return_index=True, return_counts=True)
    return pa.table({
        "word": pa.array([words[k] for k in asked], pa.string()), "n_near": pa.array(times, pa.int64()),
        "near_n": pa.array(n[near[first]], pa.int64()), "near": pa.array([words[k] for k in near[first]], pa.string()),
    })


def neighbours(words: DataFrame, crowd: int = CROWD, bucket: int = BUCKET) -> DataFrame:
    """(word, n_near, near_n, near) of the words with a neighbour; near has the largest n, ties to the smallest word.

    words: word, each once and not empty, and n.
    """
    work = WorkTables(words.sparkSession, "spelling")
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("s"))
    segments = whole.select("word", "n", F.inline(_halves(F.col("s"), F.lit(0), F.col("s"))))
    file = ["s", "lo", "hi", "head", "tail"]
    done = []
    while True:
        filed = work.save(_filed(segments))
        sizes = filed.groupBy(*file).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        crowded = (F.col("size") > crowd) & (F.col("hi") - F.col("lo") > 1)
        known, n_crowded = work.save_counting(filed.join(sizes, file).withColumn("crowded", crowded), "crowded")
        done.append(known.filter("not crowded").drop("size", "crowded"))
        if not n_crowded:
            break
        segments = known.filter("crowded").select("word", "n", F.inline(_halves(F.col("s"), F.col("lo"), F.col("hi"))))
    filed = done[0]
    for more in done[1:]:
        filed = filed.unionByName(more)
    total = filed.count()
    buckets = max(1, -(-total // (6 * bucket)))  # words of one s share a bucket; a common s has a sixth of all or more
    dealt = filed.withColumn("bucket", F.pmod(F.xxhash64(*file), F.lit(buckets)))
    answers = dealt.groupBy("s", "bucket").applyInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return answers.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"),
    )


def variant_groups(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n.

    words: word and n, its count; other columns are left out. Rows with a null or an empty word are
    ignored and repeated words are added up. form is the neighbour of largest n (ties: the
    smallest in code-point order) if it occurs `ratio` times as often at least (ratio > 1), else
    null. root is reached from the word by following forms. An empty table gives an empty one.
    """
    given = words.select("word", "n").filter("word <> '' and n is not null")
    counted = WorkTables(words.sparkSession, "words").save(given.groupBy("word").agg(F.sum("n").alias("n")))
    near = neighbours(counted, crowd, bucket)
    strong = F.col("near_n") >= ratio * F.col("n")
    work = WorkTables(words.sparkSession, "roots")
    told = work.save(counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n"),
    ))
    # Each round doubles the steps taken; a step multiplies n, so the rounds are few.
    step = told.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = step.join(ahead, "root", "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved"))
        moved, n = work.save_counting(moved, "moved")
        step = moved.drop("moved")
        if not n:
            break
    return told.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def noisy_words(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, of which about one in 31 has lost a letter.

    Only A-Z are lowered. The crc32 of `<key>:<run>` decides on the loss and its place; a null key
    is written as an empty string, a null text has no runs. Kept are words of MIN_LETTERS letters
    and MIN_TIMES occurrences at least.
    """
    lowered = F.translate(F.col(text), UPPER, LOWER)
    runs = df.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(lowered, F.lit(f"{RUN}{{{MIN_LETTERS},}}"), F.lit(0))).alias("run"))
    mark = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    size = F.length("run")
    at = (F.pmod(F.col("mark"), size)).cast("int")
    word = F.when(
        F.col("mark") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    ).otherwise(F.col("run"))
    counted = runs.withColumn("mark", mark).select(word.alias("word")).filter(F.length("word") >= MIN_LETTERS)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_TIMES)
