"""Facts per zone and step as one tall table, and the checks of drafts against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions.numeric import round_to
from stormledger.functions.ranking import grouped_row_number

# Wording of drivers and reach.
DRIVERS = {
    "surge": "storm surge", "wind": "wind", "flood": "flood susceptibility",
    "isolated_facilities": "isolated facilities", "cut_roads": "cut roads", "cut_substations": "cut substations",
    "population_density": "population density", "hospital_access": "hospital access",
    "low_literacy": "low literacy", "mapped_shelters": "few mapped shelters",
}
NAMED_STAND_INS = 10  # fixed value: stand-ins named in a text
REACH = {"direct": "direct hazard", "cut_off": "cut off by the storm"}


def _named(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]), key)


def unfold(df: DataFrame, keys: list[str], entries: list[tuple[str, Column, bool, str | None, str]]) -> DataFrame:
    """Wide columns to (keys, key, num_value, str_value, unit, source) rows, nulls left out."""
    rows = [
        F.struct(
            F.lit(name).alias("key"),
            (F.lit(None).cast("double") if text else value.cast("double")).alias("num_value"),
            (value.cast("string") if text else F.lit(None).cast("string")).alias("str_value"),
            F.lit(unit).cast("string").alias("unit"), F.lit(source).alias("source"),
        )
        for name, value, text, unit, source in entries
    ]
    return (
        df.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")
        .filter(F.col("num_value").isNotNull() | F.col("str_value").isNotNull())
    )


def zone_facts(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The figures of each zone: scores holds one row per (keys) with both horizons' scores and the
    zone's peaks and counts beside them. An access time that is null or endless gives no row."""
    c = F.col
    entries = [
        ("block_name", c("zone_name"), True, None, "reference"),
        ("timestep_utc", F.date_format("time", "dd MMM yyyy, HH:mm"), True, None, "replay"),
        ("hours_to_landfall", c("hours"), False, "h", "replay"),
        ("risk_score", round_to(c("score"), 4), False, None, "risk"),
        ("risk_score_24h", round_to(c("score_24h"), 4), False, None, "risk"),
        ("risk_hazard", round_to(c("hazard"), 4), False, None, "risk"),
        ("risk_exposure", round_to(c("exposure"), 4), False, None, "risk"),
        ("risk_vulnerability", round_to(c("vulnerability"), 4), False, None, "risk"),
        ("reach", _named(REACH, c("reach")), True, None, "risk"),
        ("top_driver", _named(DRIVERS, c("top_driver")), True, None, "risk"),
        ("hospital_median_min", F.when(c("median_s") < float("inf"), F.floor(c("median_s") / 60 + 0.5)), False, "min", "risk"),
        ("peak_surge_m", round_to(c("peak_surge"), 2), False, "m", "hazard"),
        ("peak_wind_ms", F.floor(c("peak_wind") + 0.5), False, "m/s", "hazard"),
        ("isolated_count", c("isolated"), False, None, "impact"),
        ("isolated_hospital_count", c("isolated_hospitals"), False, None, "impact"),
        ("isolated_shelter_count", c("isolated_shelters"), False, None, "impact"),
        ("expected_isolated_count", c("expected"), False, None, "impact"),
        ("cut_road_km", round_to(c("cut_m") / 1000.0, 1), False, "km", "impact"),
        ("cut_substation_count", c("substations"), False, None, "impact"),
        ("standin_count", c("shelters"), False, None, "exposure"),
        ("standin_named_count", F.least(c("named"), F.lit(NAMED_STAND_INS)), False, None, "exposure"),
    ]
    return unfold(scores, keys, entries)


def ordinal_facts(rows: DataFrame, keys: list[str], prefix: str, order: list, fields: list[str]) -> DataFrame:
    """isolated_1_name, isolated_1_cause, ..: rows numbered within their zone and step by name.

    A zone with a large share of all facilities is numbered from a parallel range sort, never in
    one task.
    """
    n = grouped_row_number(rows, keys, order, "i")
    cells = [
        F.struct(F.format_string(f"{prefix}_%d_{f}", "i").alias("key"), F.col(f).cast("string").alias("str_value")) for f in fields
    ]
    return n.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*").filter("str_value IS NOT NULL")


def named_stand_ins(shelters: DataFrame, keys: list[str]) -> DataFrame:
    """Every name of a zone's stand-ins with its ordinal i, and how many there are in all (total)."""
    names = shelters.filter("name IS NOT NULL").select(*keys, "name").distinct()
    total = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return grouped_row_number(names, keys, [F.col("name")], "i").join(total, keys)


def stale(cached: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, reason): cached keys no longer offered, and cited texts that changed."""
    both = cached.select(*keys, "key", F.col("text").alias("cached_text")).join(
        current.select(*keys, "key", F.col("str_value").alias("text"), F.lit(True).alias("offered")), [*keys, "key"], "left"
    )
    missing = F.col("offered").isNull()
    changed = F.col("text").isNotNull() & ~F.col("text").eqNullSafe(F.col("cached_text"))
    return both.filter(missing | changed).select(
        *keys, "key", F.when(missing, F.lit("missing_key")).otherwise(F.lit("changed_text")).alias("reason")
    )


def parse_pairs(texts: DataFrame, text: str, zones: DataFrame, steps: DataFrame) -> DataFrame:
    """"<zone>:<time>" lists to rows (id, code, step) or (id, item, error).

    zones: alias, code (codes and loose names); steps: label, step (T-labels and ISO times).
    """
    from stormledger.functions.labels import loose_name

    items = (
        texts.select("id", F.explode(F.split(text, ",")).alias("item"))
        .withColumn("item", F.trim("item")).filter("item <> ''")
        .withColumn("block", F.trim(F.split_part("item", F.lit(":"), F.lit(1))))
        .withColumn("when", F.trim(F.expr("substring(item, instr(item, ':') + 1)")))
        .withColumn("has_sep", F.instr("item", ":") > 0)
        .withColumn("alias", loose_name(F.col("block")))
        .withColumn("label", F.col("when"))
    )
    out = items.join(zones, "alias", "left").join(steps, "label", "left")
    error = (
        F.when(~F.col("has_sep") | (F.col("block") == "") | (F.col("when") == ""), F.lit("expected <zone>:<time>"))
        .when(F.col("code").isNull(), F.lit("unknown zone")).when(F.col("step").isNull(), F.lit("not a step"))
    )
    return out.withColumn("error", error).select(
        "id", F.when(error.isNull(), F.col("code")).alias("code"), F.when(error.isNull(), F.col("step")).alias("step"),
        F.when(error.isNotNull(), F.col("item")).alias("item"), "error",
    ).distinct()
