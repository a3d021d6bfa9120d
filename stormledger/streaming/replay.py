"""A stored table run through a stream to its end: slices in time order, state and watermark kept between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormledger.session import work_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what keyed state needs


def slices(df: DataFrame, at: str, n: int) -> list[DataFrame]:
    """n slices of df by equal spans of the column `at` (a number), the earliest first; null goes with the earliest."""
    ends = df.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    if ends["low"] is None:
        return [df]
    width = (ends["high"] - ends["low"]) / n
    number = F.least(F.lit(n - 1), F.floor((F.coalesce(at, F.lit(ends["low"])) - ends["low"]) / F.lit(width or 1.0))).cast("int")
    return [df.filter(number == k) for k in range(n)]


def replayed(
    spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str
) -> DataFrame:
    """The rows of make(stream) with the number of the micro-batch that gave them (`batch`).

    Every part is written to the shared work folder after the one before, and read by the stream
    as one micro-batch; the run ends when all are read. The checkpoint lies in the same folder, and
    a batch writes a folder of its own, so a batch that is run again gives the same rows once.
    """
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        out = make(source)
        run = (
            out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
            .foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")).start()
        )
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    schema = T.StructType([*out.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out/*")
