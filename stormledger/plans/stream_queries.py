"""Streams run to their end over the events, beside the SQL of their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormledger.plans import inputs as I
from stormledger.plans.registry import query
from stormledger.streaming import replay as RP
from stormledger.streaming import streams as ST

BATCHES = 4
_DAY = "date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT"


def _events(spark, sf):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return I.table(spark, sf, "events").withColumn("step", day)


@query(
    "ratchet_stream",
    f"""WITH t AS (SELECT user_id % 50 AS zone_id, {_DAY} AS step, event_id % 97 // 25 AS tier, (event_id % 97 // 25) * 2500e0 AS payout FROM events)
        SELECT zone_id, max(tier)::INTEGER AS released_tier, max(payout) AS released_payout, min(step) FILTER (tier = best) AS first_step
        FROM (SELECT *, max(tier) OVER (PARTITION BY zone_id) AS best FROM t) GROUP BY 1""",
)
def ratchet_stream(spark, sf):
    tier = F.floor(F.col("event_id") % 97 / 25).cast("int")
    t = _events(spark, sf).select((F.col("user_id") % 50).alias("zone_id"), "step", tier.alias("tier"), (tier * 2500.0).alias("payout"))
    out = RP.replayed(spark, RP.slices(t, "step", BATCHES), ST.ratchet_stream, "update")
    last = F.max_by(F.struct("released_tier", "released_payout", "first_step"), "batch").alias("x")
    return out.groupBy("zone_id").agg(last).select("zone_id", "x.*")


@query(
    "first_moment_stream",
    f"SELECT event_type || ' ' || (user_id % 40) AS kind, min({_DAY}) AS step FROM events GROUP BY 1",
)
def first_moment_stream(spark, sf):
    kind = F.concat("event_type", F.lit(" "), (F.col("user_id") % 40).cast("string"))
    e = _events(spark, sf).select(kind.alias("kind"), "step")
    return RP.replayed(spark, RP.slices(e, "step", BATCHES), ST.first_moment_stream, "append").select("kind", "step")


@query(
    "expected_stream",
    """WITH r AS (SELECT event_type AS cell_id, time_bucket(INTERVAL 3 HOUR, ts::TIMESTAMP) AS ts, value FROM events),
       w AS (SELECT cell_id, value, ts - to_hours((3 * k)::INTEGER) AS start FROM r, range(9) t(k))
       SELECT cell_id, start AS ts, max(value) AS value FROM w GROUP BY 1, 2""",
)
def expected_stream(spark, sf):
    """Maximum over the next 24 hours of three-hourly readings, each final once the watermark has passed its window."""
    ts = F.col("ts").cast("timestamp")
    step = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 10800) * 10800)
    r = I.table(spark, sf, "events").select(F.col("event_type").alias("cell_id"), step.alias("ts"), "value")
    parts = RP.slices(r.withColumn("at", F.unix_timestamp("ts")), "at", BATCHES)
    # A reading far ahead, after all others, moves the watermark past the last window.
    end = r.agg(F.lit(None).cast("string").alias("cell_id"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(None).cast("double").alias("value"))
    out = RP.replayed(spark, [p.drop("at") for p in parts] + [end], ST.expected_stream, "append")
    return out.filter("cell_id IS NOT NULL").select("cell_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
