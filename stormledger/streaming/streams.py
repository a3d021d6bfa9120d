"""Structured Streaming forms of operators whose meaning is incremental, and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stormledger.functions.clock import epoch_seconds


def ratchet_processor():
    """Per zone: the highest tier so far and its payout. Late rows can only raise it."""

    class Ratchet(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.best = handle.getValueState("best", "tier int, payout double, step long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            known = self.best.get() if self.best.exists() else (0, 0.0, None)
            before = known
            for batch in rows:  # one Arrow batch of the key at a time
                top = batch.sort_values(["tier", "step"], ascending=[False, True]).iloc[0]
                tier, payout, step = int(top["tier"]), float(top["payout"]), int(top["step"])
                if known[2] is None or tier > known[0] or (tier == known[0] and step < known[2]):
                    known = (tier, payout, step)
            if known != before:
                self.best.update(known)
            yield pd.DataFrame(
                {"zone_id": [key[0]], "released_tier": [known[0]], "released_payout": [known[1]], "first_step": [known[2]]}
            )

        def close(self) -> None:
            pass

    return Ratchet()


def ratchet_stream(triggers: DataFrame) -> DataFrame:
    """zone_id, step, tier, payout rows to each zone's released tier after every batch."""
    return triggers.groupBy("zone_id").transformWithStateInPandas(
        statefulProcessor=ratchet_processor(),
        outputStructType="zone_id long, released_tier int, released_payout double, first_step long",
        outputMode="Update", timeMode="None",
    )


def first_moment_stream(events: DataFrame) -> DataFrame:
    """kind, step rows to one row per kind, the first time it is seen; nothing after that."""

    class First(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "step long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            step = min(int(pdf["step"].min()) for pdf in rows)
            if not self.seen.exists():
                self.seen.update((step,))
                yield pd.DataFrame({"kind": [key[0]], "step": [step]})

        def close(self) -> None:
            pass

    return events.groupBy("kind").transformWithStateInPandas(
        statefulProcessor=First(), outputStructType="kind string, step long", outputMode="Append", timeMode="None",
    )


def expected_stream(readings: DataFrame, horizon: str = "24 hours", step: str = "3 hours") -> DataFrame:
    """cell_id, ts, value to the maximum over [ts, ts + horizon], final once the watermark has
    passed the window's end: a sliding event-time window that starts at each step."""
    span = f"{int(horizon.split()[0]) + int(step.split()[0])} hours"
    return (
        readings.withWatermark("ts", step)
        .groupBy("cell_id", F.window("ts", span, step))
        .agg(F.max("value").alias("value"), F.min("ts").alias("first_ts"))
        .select("cell_id", F.col("window.start").alias("ts"), "value", "first_ts")
    )


def dispatch_rate_stream(audit: DataFrame, limit: int, late: str = "10 minutes") -> DataFrame:
    """Live dispatches per sliding hour, and whether the limit is reached."""
    return (
        audit.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour", "1 minute"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", (F.col("n") >= limit).alias("limited"))
    )


def trailing_count(df: DataFrame, key: str, ts: str, row_id: str, seconds: int, name: str = "in_hour") -> DataFrame:
    """Batch twin of the rate guard: rows of the same key in the trailing (ts - seconds, ts].

    A key may hold any share of the rows, so the running window is cut by time: every row goes to
    the slot it falls in and, as history only, to the next one. A slot's window never spans more
    than two slots of one key.
    """
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts).cast("timestamp_ntz"))
    slot = F.floor(epoch_seconds(F.col(ts)) / F.lit(seconds)).cast("long")
    copies = F.array(
        F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))
    )
    w = Window.partitionBy(key, "slot").orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return (
        df.select("*", micros.alias("_us"), F.explode(copies).alias("_x"))
        .select(*df.columns, "_us", F.col("_x.slot").alias("slot"), F.col("_x.own").alias("own"))
        .withColumn(name, F.count(row_id).over(w))
        .filter("own")
        .drop("_us", "slot", "own")
    )
