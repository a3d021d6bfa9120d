"""Documents packed into sequences: shortest pack first over the histogram of lengths.

Lengths are at most the sequence length, so their histogram is a table of bounded size; it is all
the driver sees. Lengths are placed longest first: each copy goes to the shortest pack it fits
into, many equal packs at a time, and opens packs of its own where none is left. A placement is a
row (length, first rank, count, first sequence, offset): the copies of this length with these ranks
lie at this offset of consecutive sequences. Sequences are numbered so that every placement's are
consecutive: a pack's placements form a path in a tree, and the tree is numbered depth first.

Documents find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormledger.functions.ranking import grouped_row_number
from stormledger.llm.arrow import pieces
from stormledger.llm.encode import encoder
from stormledger.session import WorkTables

LENGTH = 4096
BROADCAST_PLACEMENTS = 250_000  # of 40 bytes each: about 10 MB
PLACEMENTS = "length int, first_rank long, copies long, first_sequence long, offset int"
CUT = [
    T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
]


def cut_documents(df: DataFrame, text: str, path: str, kind: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """df without its text: a row per piece of at most `length` ids, the text's ids and then end_id.

    start is the number of the document's ids before the piece, doc_tokens their number in all; ids
    are little-endian unsigned 32-bit integers. A null or empty text is the end id alone. Columns
    start, length, doc_tokens and ids are replaced.
    """
    inputs = df.drop(*[f.name for f in CUT if f.name != text])
    others = [f for f in inputs.schema.fields if f.name != text]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = encoder(path, kind).ids
        end = int(end_id).to_bytes(4, "little")
        for part in pieces(batches, text):
            rows, starts, sizes, totals, ids = [], [], [], [], []
            for row, body in enumerate(part.column(part.schema.get_field_index(text))):
                found = encode(body.as_py()) + end
                for at in range(0, len(found), 4 * length):
                    piece = found[at:at + 4 * length]
                    rows.append(row)
                    starts.append(at // 4)
                    sizes.append(len(piece) // 4)
                    totals.append(len(found) // 4)
                    ids.append(piece)
            kept = part.select([f.name for f in others]).take(pa.array(np.array(rows, np.int64)))
            made = [pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*kept.schema.names, *[f.name for f in CUT]])

    return inputs.mapInArrow(run, T.StructType([*others, *CUT]))


def placements(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """PLACEMENTS' rows for so many pieces of each length (1 .. length)."""
    placed: list[list] = []  # [length, first rank, copies, offset, parent]
    packs: list[tuple[int, int, int]] = []  # heap of (used, number of the last placement, packs)

    def place(size: int, rank: int, copies: int, offset: int, parent: int) -> None:
        placed.append([size, rank, copies, offset, parent])
        heapq.heappush(packs, (offset + size, len(placed) - 1, copies))

    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            if packs and packs[0][0] + size <= length:
                used, last, count = heapq.heappop(packs)
                copies = min(count, left)
                if copies < count:
                    heapq.heappush(packs, (used, last, count - copies))
                place(size, rank, copies, used, last)
            else:  # as many packs as the rest fills, one copy each; the loop then adds the others
                copies = -(-left // (length // size))
                place(size, rank, copies, 0, -1)
            rank, left = rank + copies, left - copies

    children: dict[int, list[int]] = {}
    for number, p in enumerate(placed):
        children.setdefault(p[4], []).append(number)
    first = [0] * len(placed)
    walk = [(-1, 0)]
    while walk:
        number, at = walk.pop()
        for child in children.get(number, []):
            first[child] = at
            walk.append((child, at))
            at += placed[child][2]
    return [(p[0], p[1], p[2], first[k], p[3]) for k, p in enumerate(placed)]


def pack(cut: DataFrame, order: list[str], length: int = LENGTH) -> DataFrame:
    """cut (column length: 1 .. length) with sequence_id and offset, both from 0 and gapless.

    Equal lengths are ranked by `order`, nulls first, ties told apart by a hash of the whole row;
    equal rows are interchangeable, and each gets a place. No rows give no rows. Columns
    sequence_id and offset are replaced.
    """
    work = WorkTables(cut.sparkSession, "packing")
    kept = cut.drop("sequence_id", "offset")
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in kept.columns])
    rows = work.save(kept.withColumn("_tie", tie))
    counted = rows.groupBy("length").count().collect()  # at most `length` rows
    found = placements({r["length"]: r["count"] for r in counted}, length)
    by = [F.col(c).asc_nulls_first() for c in order] + [F.col("_tie").asc()]
    ranked = grouped_row_number(rows, ["length"], by, "_rank").drop("_tie").withColumn("_rank", F.col("_rank") - 1)
    places = cut.sparkSession.createDataFrame(found, PLACEMENTS)
    if len(found) <= BROADCAST_PLACEMENTS:
        places = F.broadcast(places)
    within = (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("first_rank") + F.col("copies"))
    here = (F.col("length") == F.col("_length")) & within
    return ranked.join(places.withColumnRenamed("length", "_length"), here).withColumn(
        "sequence_id", F.col("first_sequence") + F.col("_rank") - F.col("first_rank")
    ).drop("_rank", "_length", "first_rank", "copies", "first_sequence")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the ids of each sequence, its pieces (with their ids) joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))
