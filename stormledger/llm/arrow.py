"""Row-wise helpers over Arrow batches, in pieces small enough that results never pile up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PIECE_BYTES = 4 << 20  # text bytes of the rows handled at once; a longer row goes alone
SMALL_BYTES = 1 << 20  # the same where what is made of a text takes many times its size
PIECE_ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = PIECE_ROWS) -> Iterator[None]:
    """For jobs over whole texts run inside: an executor and its workers hold batches of at most so many rows."""
    before = spark.conf.get(BATCH)
    if int(before) > rows or int(before) <= 0:
        spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def pieces(batches: Iterable, text: str, most: int = PIECE_BYTES) -> Iterator:
    """The batches, sliced to at most so many bytes of the text column (or one row).

    A batch is let go before the next one is read; who takes a slice should do so too.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, before + most, "right"))
            stop = min(max(stop, at + 1), at + PIECE_ROWS)
            yield batch.slice(at, stop - at)
            at = stop
        del batch, size
        pa.default_memory_pool().release_unused()


def add_columns(
    df: DataFrame, text: str, made: list[T.StructField], make: Callable[[list], list[list]], drop_text: bool = False
) -> DataFrame:
    """df with the columns `made`; make gives their values for a list of texts (null: None).

    Columns of df with one of these names are replaced. With drop_text, texts do not come back.
    """
    names = [f.name for f in made]
    inputs = df.drop(*[c for c in names if c != text])
    others = [f for f in inputs.schema.fields if not drop_text or f.name != text]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(T.StructType(made))
        for part in pieces(batches, text, SMALL_BYTES):
            values = make(part.column(part.schema.get_field_index(text)).to_pylist())
            new = [pa.array(v, types.field(k).type) for k, v in enumerate(values)]
            if drop_text:  # a copy, as slices would hold the texts they came with
                part = part.select([f.name for f in others]).take(pa.array(np.arange(part.num_rows)))
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])
            del part, values, new

    return inputs.mapInArrow(run, T.StructType([*others, *made]))
