"""A hashed maximum-entropy language model over words, trained and scored on Spark.

P(word | history) = P(class | history) * P(word | class). The first factor is a softmax over CLASSES
classes whose scores add up weight rows of hashed features of the history: the word before, the two
words before, the words two and three before (skips), the classes of the two words before, and a
bias. Classes are the end of a text, the most frequent words (a class each), and groups of all other
words by their last letters and whether they end a sentence. In a group, a word's share is its
count plus 0.5; words never seen in training share one such entry per group.

Corpus. Documents become chunks: distinct words and, for each document, their numbers. Words are
counted over all training documents by one aggregation; counts come back to a chunk for its distinct
words only. Training: every worker starts a round from the same weights, takes AdaGrad steps over
its chunks' training documents (a share of them each round, so that each document is used once),
and returns its changed rows with the number of tokens behind them; per row, the changes are averaged
by these numbers, in two steps so that no task collects all workers'. Scoring runs in numpy batches.

The number of weight rows follows the number of distinct words learnt from, so that features of a
larger corpus do not fall on the same rows; a worker holds them three times, which sets MOST_ROWS.
The driver holds the weights, at most MOST_ROWS x CLASSES, the top words and class totals.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormledger.session import WorkTables

ROWS, MOST_ROWS, CLASSES = 1 << 13, 1 << 18, 64
WORDS_PER_ROW = 128
SUFFIXES = 16  # groups of other words: so many endings, with and without a sentence mark
TOP_WORDS = CLASSES - 1 - 2 * SUFFIXES
END, END_CLASS = "", 0  # the end of a text, written like a word that no text can hold
ROUNDS, RATE, BATCH = 2, 0.2, 8192
CHUNK_TOKENS, PART_TOKENS = 4_000_000, 500_000  # of a chunk, and of its part worked on at once
BLOCK_ROWS = 512
FEW = 64  # tokens of a row in a step that are added one by one, for all rows at once
CACHED_ROWS = 1024  # of CLASSES numbers, worked on while they are in a core's cache
WORKERS_PER_CORE = 2
MARKS = ".!?"
STRIPPED = "\"'()[]{}.,;:!?-_*#$%&<>|"
CHUNK = "_words array<string>, _trained array<long>, _codes binary, _sizes array<int>, _held array<boolean>"


def _chunks(rows: DataFrame) -> DataFrame:
    """rows: key, text, held. One row per chunk: keys and CHUNK's columns."""
    schema = T.StructType([T.StructField("_keys", T.ArrayType(rows.schema["key"].dataType)), *T._parse_datatype_string(CHUNK).fields])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        from stormledger.llm.arrow import pieces

        types = to_arrow_schema(schema)
        keys, held, words, sizes, waiting = [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            counts, is_held = np.concatenate(sizes), np.concatenate(held)
            coded = pa.concat_arrays(words).dictionary_encode()
            ends = np.cumsum(counts + 1) - 1  # each text's words, then its end, which is number 0
            codes = np.zeros(int(counts.sum()) + len(counts), "<u4")
            at_word = np.ones(len(codes), bool)
            at_word[ends] = False
            codes[at_word] = coded.indices.to_numpy() + 1
            known = pa.concat_arrays([pa.array([END]), coded.dictionary])
            trained = np.bincount(codes[np.repeat(~is_held, counts + 1)], minlength=len(known))
            lists = [pa.concat_arrays(keys), known, trained, None, counts + 1, is_held]
            row = [
                pa.array([zlib.compress(codes, 1)], f.type) if own is None
                else pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own).cast(f.type.value_type))
                for own, f in zip(lists, types)
            ]
            return pa.RecordBatch.from_arrays([own.cast(f.type) for own, f in zip(row, types)], schema=types)

        for part in pieces(batches, "text"):
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column(1), "")))
            flat, parents = split.flatten(), pc.list_parent_indices(split)
            real = pc.not_equal(flat, "")
            words.append(flat.filter(real))
            sizes.append(np.bincount(parents.filter(real).to_numpy(zero_copy_only=False), minlength=len(split)))
            keys.append(part.column(0))
            held.append(part.column(2).to_numpy(zero_copy_only=False).astype(bool))
            waiting += int(sizes[-1].sum())
            if waiting >= CHUNK_TOKENS:
                yield chunk()
                keys, held, words, sizes, waiting = [], [], [], [], 0
        if keys:
            yield chunk()

    return rows.mapInArrow(run, schema)


class Words:
    """Numbers and classes of words; top: the words with a class of their own, most frequent first."""

    def __init__(self, top: list[str]) -> None:
        self.own = {w: 1 + k for k, w in enumerate(top)} | {END: END_CLASS}

    def classes(self, words: list[str]):
        import numpy as np
        from xxhash import xxh32_intdigest

        first = 1 + TOP_WORDS
        found, of_tail = [], {}
        for w in words:
            own = self.own.get(w)
            if own is None:
                tail = w[-4:] if w[-1] in STRIPPED else w[-2:]
                own = of_tail.get(tail)
            if own is None:
                ending = w.rstrip(STRIPPED)[-2:]
                own = first + 2 * (xxh32_intdigest(ending.encode()) % SUFFIXES) + (w[-1] in MARKS)
                if tail.rstrip(STRIPPED)[-2:] == ending and len(ending) == 2:  # any word of this tail ends alike
                    of_tail[tail] = own
            found.append(own)
        return np.array(found, np.int64)

    def numbers(self, words: list[str]):
        import numpy as np
        from xxhash import xxh32_intdigest

        return np.fromiter((xxh32_intdigest(w) for w in words), np.int64, len(words))


class History:
    """The features of every token of a chunk."""

    def __init__(self, codes, sizes, numbers, classes) -> None:
        import numpy as np

        self.ends = np.cumsum(sizes)
        self.target = classes[codes]
        place = np.arange(len(codes)) - np.repeat(self.ends - sizes, sizes)
        word, kind = numbers[codes], self.target

        def back(values, steps: int):
            moved = np.zeros_like(values)
            moved[steps:] = values[:-steps] + 1
            moved[place < steps] = 0
            return moved

        self.words = [back(word, s) for s in (1, 2, 3)]
        self.kinds = [back(kind, s) for s in (1, 2)]

    def rows(self, at, size: int = ROWS):
        """(features, tokens) of weight rows, of which there are `size`; row 0 is the bias."""
        import numpy as np

        one, two, three = (w[at] for w in self.words)
        near, far = (k[at] for k in self.kinds)
        found = np.zeros((6, len(one)), np.int64)
        for k, value in enumerate((one, one * 0x9E3779B1 + two, two, three, near * (CLASSES + 1) + far)):
            mixed = (value.astype(np.uint64) + np.uint64((k + 1) * 0x85EBCA6B)) * np.uint64(0x9E3779B97F4A7C15)
            found[k + 1] = 1 + ((mixed >> np.uint64(32)) % np.uint64(size - 1)).astype(np.int64)
        return found


def _scores(weights, rows):
    """(tokens, CLASSES): added up weights, 0 for the best class. rows[0] is the bias, which all tokens share."""
    import numpy as np

    scores = np.empty((rows.shape[1], weights.shape[1]), weights.dtype)
    for at in range(0, len(scores), CACHED_ROWS):
        own = scores[at:at + CACHED_ROWS]
        np.take(weights, rows[1, at:at + CACHED_ROWS], axis=0, out=own, mode="clip")
        own += weights[0]
        for feature in rows[2:, at:at + CACHED_ROWS]:
            own += weights.take(feature, axis=0, mode="clip")
        own -= own.max(axis=1, keepdims=True)
    return scores


def _log_classes(weights, rows):
    """(tokens, CLASSES): log probabilities."""
    import numpy as np

    scores = _scores(weights, rows)
    scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    return scores


def _log_targets(weights, rows, target):
    """The tokens' log probabilities of their own classes."""
    import numpy as np

    logs = np.empty(len(target), weights.dtype)
    for at in range(0, len(target), CACHED_ROWS):
        scores = _scores(weights, rows[:, at:at + CACHED_ROWS])
        own = scores[np.arange(len(scores)), target[at:at + CACHED_ROWS]]
        logs[at:at + CACHED_ROWS] = own - np.log(np.exp(scores, out=scores).sum(axis=1))
    return logs


def _step(weights, squares, seen, history: History, at) -> None:
    """One AdaGrad step on the tokens `at`; the slopes of a row's tokens are added up class by class.

    Only rows of these tokens are read or written, so a step costs the same for any number of rows.
    """
    import numpy as np

    rows = history.rows(at, len(weights))
    slope = _scores(weights, rows)
    np.exp(slope, out=slope)
    slope /= slope.sum(axis=1, keepdims=True)
    slope[np.arange(len(at)), history.target[at]] -= 1
    flat = rows[1:].ravel()
    met = np.zeros(len(weights), bool)
    met[0] = met[flat] = True
    moved = np.flatnonzero(met)
    place = np.empty(len(weights), np.min_scalar_type(len(moved)))
    place[moved] = np.arange(len(moved))
    place = place[flat]
    # A row's tokens stand together in `order`. Rows of most tokens come first, so that those with a token more to add
    # are the first ones; the bias, which is no feature, is the last.
    order = np.argsort(place, kind="stable") % len(at)
    tokens = np.bincount(place, minlength=len(moved))
    often = np.argsort(tokens, kind="stable")[::-1]
    starts = (np.cumsum(tokens) - tokens)[often]
    moved, tokens = moved[often], tokens[often]
    more = len(moved) - np.searchsorted(tokens[::-1], np.arange(FEW + 1), "right")  # rows of more tokens than so many
    total = slope.take(order.take(starts, mode="clip"), axis=0, mode="clip")
    for rank in range(1, FEW):
        if more[rank]:
            total[:more[rank]] += slope.take(order.take(starts[:more[rank]] + rank), axis=0, mode="clip")
    for k in range(more[FEW]):
        total[k] += slope.take(order[starts[k] + FEW:starts[k] + tokens[k]], axis=0, mode="clip").sum(axis=0)
    total[-1] = slope.sum(axis=0, dtype=np.float64)
    for first in range(0, len(moved), CACHED_ROWS):
        some = moved[first:first + CACHED_ROWS]
        own = total[first:first + CACHED_ROWS]
        gone = squares.take(some, axis=0) + own * own
        squares[some] = gone
        gone += 1
        np.sqrt(gone, out=gone)
        own *= RATE
        own /= gone
        weights[some] -= own
    seen[moved] += tokens
    seen[0] += len(at)


def _read_chunk(chunk, k: int, words: Words):
    """The k-th chunk: its words' numbers by token, documents' sizes, whether they are held out, numbers and classes by word."""
    import numpy as np

    codes = np.frombuffer(zlib.decompress(chunk["_codes"][k].as_py()), "<u4").astype(np.int64)
    sizes, held, listed = (chunk[c][k].values.to_numpy(zero_copy_only=False) for c in ("_sizes", "_held", "_words"))
    listed = listed.tolist()
    return codes, sizes.astype(np.int64), held.astype(bool), words.numbers(listed), words.classes(listed)


def _parts(codes, sizes):
    """(first document, documents' sizes, their codes) of successive parts, at least one document each."""
    import numpy as np

    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + PART_TOKENS, "right")))
        yield at, sizes[at:stop], codes[before:int(ends[stop - 1])]
        at = stop


def weight_rows(distinct: int) -> int:
    """The number of weight rows for so many distinct words, a power of two."""
    return min(MOST_ROWS, max(ROWS, 1 << (distinct // WORDS_PER_ROW).bit_length()))


def _changes(chunks: DataFrame, words, weights, number: int) -> DataFrame:
    """block, weighted change and tokens of the rows that a round of training moves."""

    workers = max(1, WORKERS_PER_CORE * chunks.sparkSession.sparkContext.defaultParallelism)
    spread = math.isqrt(workers - 1) + 1

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        start = weights.value
        own = start.copy()
        squares, seen = np.zeros_like(own), np.zeros(len(own), np.float32)
        for batch in batches:
            for k in range(batch.num_rows):
                codes, sizes, held, numbers, classes = _read_chunk(batch, k, words.value)
                turn = (np.arange(len(sizes)) % ROUNDS == number) & ~held
                for first, part_sizes, part_codes in _parts(codes, sizes):
                    history = History(part_codes, part_sizes, numbers, classes)
                    used = np.flatnonzero(np.repeat(turn[first:first + len(part_sizes)], part_sizes))
                    for at in range(0, len(used), BATCH):
                        _step(own, squares, seen, history, used[at:at + BATCH])
        cut = {b: slice(b * BLOCK_ROWS, (b + 1) * BLOCK_ROWS) for b in range(len(own) // BLOCK_ROWS)}
        cut = {b: c for b, c in cut.items() if seen[c].any()}
        yield pa.RecordBatch.from_arrays([
            pa.array(list(cut), pa.int32()), pa.array([TaskContext.get().partitionId() % spread] * len(cut), pa.int32()),
            pa.array([(own[c] - start[c]).astype(np.float16).tobytes() for c in cut.values()], pa.binary()),
            pa.array([seen[c].tobytes() for c in cut.values()], pa.binary()),
        ], ["block", "part", "change", "seen"])

    def adding(kind):
        """Changes of workers are weighted by their tokens, sums of them are added up."""

        def add(table):
            import numpy as np
            import pyarrow as pa

            change, tokens = np.zeros((BLOCK_ROWS, CLASSES)), np.zeros(BLOCK_ROWS)
            for moved, seen in zip(table.column("change"), table.column("seen")):
                own = np.frombuffer(seen.as_py(), np.float32)
                rows = np.frombuffer(moved.as_py(), kind).reshape(-1, CLASSES).astype(np.float64)
                change += rows * own[:, None] if kind == "float16" else rows
                tokens += own
            return pa.table({
                "block": table.column("block")[:1], "part": table.column("part")[:1],
                "change": pa.array([change.astype(np.float32).tobytes()], pa.binary()), "seen": pa.array([tokens.astype(np.float32).tobytes()], pa.binary()),
            })

        return add

    kind = "block int, part int, change binary, seen binary"
    moved = chunks.coalesce(workers).select("_words", "_codes", "_sizes", "_held").mapInArrow(run, kind)
    return moved.groupBy("block", "part").applyInArrow(adding("float16"), kind).groupBy("block").applyInArrow(adding("float32"), kind)


def score_texts(df: DataFrame, key: str, held_out, text: str = "text") -> DataFrame:
    """A row per row of df: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out is a condition; rows for which it is not true are trained on. A token is a word (a run
    of other than ASCII white space, A-Z lowered) or the end of a text; a null or empty text is its
    end alone. base_score adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens, score the
    model's log10 probabilities. Repeated rows are scored, and trained on, one by one. Without
    training rows all counts are 0 and classes equally likely. No rows give no rows.
    """
    spark = df.sparkSession
    work = WorkTables(spark, "maxent")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = work.save(_chunks(rows).withColumn("_chunk", F.monotonically_increasing_id()))
    listed = chunks.select("_chunk", F.posexplode(F.arrays_zip("_words", "_trained")).alias("local", "w")).select(
        "_chunk", "local", F.col("w._words").alias("word"), F.col("w._trained").alias("trained")
    )
    counts = work.save(listed.groupBy("word").agg(F.sum("trained").alias("c")))
    seen = counts.filter("c > 0")
    top = seen.filter(F.col("word") != END).orderBy(F.desc("c"), "word").limit(TOP_WORDS).collect()
    words = spark.sparkContext.broadcast(Words([r["word"] for r in top]))

    def classed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kinds = words.value.classes(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(kinds), batch.column(1)], ["class", "c"])

    import numpy as np

    totals = np.zeros((CLASSES, 2))
    for r in seen.mapInArrow(classed, "class long, c long").groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        totals[r["class"]] = r["n"], r["v"]  # at most CLASSES rows
    n, v = int(totals[:, 0].sum()), int(totals[:, 1].sum())
    start = np.zeros((weight_rows(v), CLASSES), np.float32)
    start[0] = np.log((totals[:, 0] + 0.5) / (n + 0.5 * CLASSES))
    for number in range(ROUNDS):
        weights = spark.sparkContext.broadcast(start)
        start = start.copy()
        for r in _changes(chunks, words, weights, number).collect():  # as many numbers as weights
            at = slice(r["block"] * BLOCK_ROWS, (r["block"] + 1) * BLOCK_ROWS)
            tokens = np.frombuffer(r["seen"], np.float32)[:, None]
            start[at] += np.frombuffer(r["change"], np.float32).reshape(-1, CLASSES) / np.maximum(tokens, 1)
    weights = spark.sparkContext.broadcast(start)
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ])

    def score(chunk, counted):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types, columns = to_arrow_schema(schema), [[] for _ in schema.fields]
        for row in range(chunk.num_rows):
            codes, sizes, held, numbers, classes = _read_chunk(chunk, row, words.value)
            keys = chunk["_keys"][row].values
            c = np.zeros(len(classes), np.int64)
            c[counted.column("local").to_numpy()] = counted.column("c").to_numpy()
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            inside = np.log((c + 0.5) / (totals[classes, 0] + 0.5 * (totals[classes, 1] + 1)))
            inside[classes <= TOP_WORDS] = 0  # alone in its class
            for at, part_sizes, part in _parts(codes, sizes):
                history = History(part, part_sizes, numbers, classes)
                logs = np.empty(len(part))
                for k in range(0, len(part), BATCH):
                    some = np.arange(k, min(k + BATCH, len(part)))
                    logs[some] = _log_targets(weights.value, history.rows(some, len(weights.value)), history.target[some])
                first, stop = history.ends - part_sizes, at + len(part_sizes)
                values = [
                    keys[at:stop].to_pylist(), held[at:stop].tolist(), part_sizes, np.add.reduceat((c > 0)[part].astype(np.int64), first),
                    np.full(len(part_sizes), n), np.add.reduceat(base[part], first), np.add.reduceat(logs + inside[part], first) / np.log(10),
                ]
                for own, made in zip(columns, values):
                    own += made if isinstance(made, list) else made.tolist()
        return pa.table([pa.array(own, f.type) for own, f in zip(columns, types)], schema=types)

    known = listed.select("_chunk", "local", "word").join(counts, "word").select("_chunk", "local", "c")
    known = known.withColumnRenamed("_chunk", "_of")
    return chunks.drop("_trained").groupBy("_chunk").cogroup(known.groupBy("_of")).applyInArrow(score, schema)
