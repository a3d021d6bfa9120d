"""Token-id files: documents in key order, their ids in compressed segments, a directory beside them.

A file set is a Parquet folder, so any store that Spark writes to will do, and a lost task leaves
nothing behind. A row is a segment: shard (ascending with the keys), segment (within the shard),
first (ids of the shard before it), n_ids, payload (see rangecoder), and its documents' keys and
numbers of ids, in order. A document lies in one segment, which it extends where it is long.
Segments and, in them, blocks can be read by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormledger.llm.arrow import SMALL_BYTES, pieces, small_batches
from stormledger.llm.encode import encoder

SEGMENT_IDS = 2 << 20  # bounds a worker's memory while it codes a segment


def write_ids(
    df: DataFrame, key: str, folder: str, path: str, kind: str, end_id: int, text: str = "text", segment_ids: int = SEGMENT_IDS
) -> None:
    """Encodes each whole text, appends end_id, and writes the ids of all rows in ascending key order.

    Null keys come first; rows with equal keys are ordered by a hash of their texts, and equal rows
    are interchangeable. A null or empty text is the end id alone. No rows give a folder of no rows.
    """
    kind_of_key = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    placed = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("text"))
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("first", T.LongType()),
        T.StructField("n_ids", T.LongType()), T.StructField("payload", T.BinaryType()),
        T.StructField("keys", T.ArrayType(kind_of_key)), T.StructField("sizes", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        from stormledger.llm.rangecoder import encode

        types = to_arrow_schema(schema)
        shard = TaskContext.get().partitionId()
        coder = encoder(path, kind)
        keys, ids, sizes, waiting, number, first = [], [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            row = [shard, number, first, waiting, encode(np.concatenate(ids)), keys, np.concatenate(sizes)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, types)], schema=types)

        for part in pieces(batches, "text", SMALL_BYTES):
            own, found, counts = part.column(0).to_pylist(), *coder.batch(part.column(1))
            del part
            ends = np.cumsum(counts + 1)
            found = np.insert(found, np.cumsum(counts), end_id)
            at = before = 0
            while at < len(own):
                stop = min(len(own), 1 + int(np.searchsorted(ends, before + segment_ids - waiting)))
                keys += own[at:stop]
                ids.append(found[before:ends[stop - 1]])
                sizes.append(counts[at:stop] + 1)
                waiting += len(ids[-1])
                at, before = stop, int(ends[stop - 1])
                if waiting >= segment_ids:
                    yield segment()
                    number, first = number + 1, first + waiting
                    keys, ids, sizes, waiting = [], [], [], 0
        if keys:
            yield segment()

    with small_batches(df.sparkSession):
        placed.mapInArrow(run, schema).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens and ids of every document of a file set.

    ids are little-endian unsigned 32-bit integers. A block with a wrong checksum fails the job.
    """
    files = spark.read.parquet(folder)
    key = files.schema["keys"].dataType.elementType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("key", key), T.StructField("local", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from stormledger.llm.rangecoder import decode

        types = to_arrow_schema(schema)
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first, payload, keys, sizes = (batch.column(c)[row] for c in range(5))
                ids = memoryview(decode(payload.as_py())).cast("B")
                ends = np.cumsum(np.array(sizes.as_py(), np.int64))
                keys, starts = keys.values, ends - np.array(sizes.as_py(), np.int64)
                for at in range(0, len(ends), 1000):
                    some = slice(at, at + 1000)
                    values = [
                        pa.array([shard.as_py()] * len(ends[some]), types.field(0).type), keys[some.start:some.stop],
                        pa.array(starts[some] + first.as_py()), pa.array(ends[some] - starts[some]),
                        pa.array([ids[4 * a:4 * z] for a, z in zip(starts[some].tolist(), ends[some].tolist())], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(values, schema=types)

    documents = files.select("shard", "first", "payload", "keys", "sizes").mapInArrow(run, schema)
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # One row per shard, that is, per task that wrote: small enough for every reader.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return documents.join(F.broadcast(shards), "shard").select(
        "key", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids"
    )
