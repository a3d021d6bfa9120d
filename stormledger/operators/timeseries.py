"""Per-key series over steps: forward maxima, runs, first times, deadlines, ratchets.

Windows here partition by an entity and run over its steps, so a partition is as long as the time
axis, never as large as the data. Series over raw rows are first reduced to one row per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormledger.functions.geo import forward_azimuth, haversine_m
from stormledger.functions.numeric import round_to


def ahead_columns(
    df: DataFrame, keys: list[str], step: str, values: list[str], horizon_h: int = 24, step_h: int = 3
) -> DataFrame:
    """<value>_ahead: each value's maximum over this step and the ones within the horizon, capped at
    the last step; every value column on its own."""
    w = Window.partitionBy(*keys).orderBy(step).rangeBetween(0, horizon_h // step_h)
    return df.withColumns({f"{v}_ahead": F.max(v).over(w) for v in values})


def unfold_horizons(df: DataFrame, values: list[str], horizon_h: int = 24) -> DataFrame:
    """Rows at horizon 0 and at `horizon_h` from values and their _ahead columns."""
    others = [c for c in df.columns if c not in values and c not in [f"{v}_ahead" for v in values]]
    now = F.struct(F.lit(0).alias("horizon_h"), *[F.col(v) for v in values])
    later = F.struct(F.lit(horizon_h).alias("horizon_h"), *[F.col(f"{v}_ahead").alias(v) for v in values])
    return df.select(*others, F.explode(F.array(now, later)).alias("x")).select(
        *others, "x.horizon_h", *[f"x.{v}" for v in values]
    )


def expected_max(
    df: DataFrame, keys: list[str], step: str, values: list[str], horizon_h: int = 24,
    step_h: int = 3,
) -> DataFrame:
    """Each row at horizon 0 as it is, and at `horizon_h` with the maximum over the steps ahead.

    One window, one pass: both horizons are unfolded from the same row.
    """
    return unfold_horizons(ahead_columns(df, keys, step, values, horizon_h, step_h), values, horizon_h)


def whole_event_max(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def ratchet(df: DataFrame, keys: list[str], step: str, tier: str, payout: str) -> DataFrame:
    """Highest tier so far and the payout of the row that first reached it."""
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    first_best = F.struct(F.col(tier), -F.col(step))
    return df.withColumn("released_tier", F.max(tier).over(w)).withColumn(
        "released_payout", F.max_by(payout, first_best).over(w)
    )


def running_since(df: DataFrame, keys: list[str], step: str, flag: str, ts: str) -> DataFrame:
    """Flagged rows with the time their unbroken run of steps began; a missing step ends a run."""
    by_step = Window.partitionBy(*keys).orderBy(step)
    run = Window.partitionBy(*keys, "run_id")
    return (
        df.filter(flag)
        .withColumn("run_id", F.col(step) - F.row_number().over(by_step))
        .withColumn("since", F.min(ts).over(run))
        .drop("run_id")
    )


def next_time(
    df: DataFrame, keys: list[str], step: str, flag: str, ts: str, within: int | None = None
) -> DataFrame:
    """The next later time the flag holds, null if never (or not within `within` steps)."""
    w = Window.partitionBy(*keys).orderBy(step)
    frame = (
        w.rowsBetween(1, Window.unboundedFollowing) if within is None else w.rangeBetween(1, within)
    )
    return df.withColumn("next_ts", F.min(F.when(F.col(flag), F.col(ts))).over(frame))


def first_moments(df: DataFrame, kinds: DataFrame, kind: str, step: str, name: str) -> DataFrame:
    """Per kind the first step it occurs and how many distinct names occur then; kinds that never
    occur keep a null step."""
    per_step = df.groupBy(kind, step).agg(
        F.count_distinct(name).alias("names"), F.min(name).alias("first_name")
    )
    first = per_step.groupBy(kind).agg(
        F.min_by(F.struct(step, "names", "first_name"), step).alias("x")
    )
    return kinds.join(first, kind, "left").select(
        kind, F.col(f"x.{step}").alias(step), "x.names", "x.first_name"
    )


def deadlines(df: DataFrame, keys: list[str], step: str, open_flag: str) -> DataFrame:
    """The last step before the first closed one.

    No closed step: the last step, `stays_open`. Closed from the start: null.
    """
    first = F.min(F.when(~F.col(open_flag), F.col(step))).over(Window.partitionBy(*keys))  # an entity's steps
    # The last step that exists before it: the axis may have gaps.
    before = F.max(F.when(F.col("closed").isNull() | (F.col(step) < F.col("closed")), F.col(step)))
    return df.withColumn("closed", first).groupBy(*keys, "closed").agg(before.alias("deadline")).select(
        *keys, "deadline", F.col("closed").isNull().alias("stays_open")
    )


def motion(track: DataFrame, keys: list[str], step: str, step_s: float = 10800.0) -> DataFrame:
    """Forward speed and heading towards the next fix; the last fix keeps the previous ones."""
    w = Window.partitionBy(*keys).orderBy(step)
    lat2, lon2 = F.lead("lat").over(w), F.lead("lon").over(w)
    moved = track.withColumn(
        "speed_raw", round_to(haversine_m(F.col("lat"), F.col("lon"), lat2, lon2) / F.lit(step_s), 2)
    ).withColumn(
        "heading_raw", round_to(forward_azimuth(F.col("lat"), F.col("lon"), lat2, lon2), 2)
    )
    return (
        moved.withColumn("forward_speed", F.coalesce("speed_raw", F.lag("speed_raw").over(w)))
        .withColumn("heading", F.coalesce("heading_raw", F.lag("heading_raw").over(w)))
        .drop("speed_raw", "heading_raw")
    )


def step_change(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Change since the previous step, hidden when nothing changed or it rose from zero."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(step))
    change = F.col(value) - before
    return df.withColumn("delta", F.when((change != 0) & (before != 0), change))


def step_ratio(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Largest ratio between consecutive steps per key (smoothness check)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(step))
    return (
        df.withColumn("ratio", F.when(before > 0, F.col(value) / before))
        .groupBy(*keys)
        .agg(F.max("ratio").alias("max_ratio"))
    )


def on_axis(counts: DataFrame, axis_df: DataFrame, keys: list[str], step: str) -> DataFrame:
    """A series with a row for every step of the axis; missing steps stay null."""
    return axis_df.join(counts, [*keys, step], "left")


def series_peak(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """The first step of the highest value."""
    return df.groupBy(*keys).agg(
        F.max(value).alias("peak"),
        F.max_by(step, F.struct(F.col(value), -F.col(step))).alias("peak_step"),
    )


def track_part(step: Column, now: Column, horizon_steps: int = 8) -> Column:
    return (
        F.when(step <= now, F.lit("past"))
        .when(step <= now + F.lit(horizon_steps), F.lit("next"))
        .otherwise(F.lit("later"))
    )
