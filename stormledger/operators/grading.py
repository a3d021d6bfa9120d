"""Grading features and links against threshold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OK, AT_RISK, CUT, ISOLATED = 0, 1, 2, 3
STATUS = ["ok", "at_risk", "cut", "isolated"]

# Fixed values: (kind, hazard, metric, at-risk threshold, cut threshold); None never fires.
RULES = [
    ("road", "surge", "value", 0.15, 0.3),
    ("road", "flood", "severity", 0.7, None),
    ("ferry", "wind", "value", 12.0, 17.0),
    ("substation", "surge", "value", None, 0.5),
    ("substation", "flood", "severity", 0.7, None),
    ("substation", "wind", "value", 33.0, None),
    ("power_line", "wind", "value", 33.0, None),
    ("hospital", "surge", "value", 0.15, None),
    ("hospital", "flood", "severity", 0.7, None),
    ("hospital", "wind", "value", 33.0, None),
    ("shelter", "surge", "value", 0.15, None),
    ("shelter", "flood", "severity", 0.7, None),
    ("shelter", "wind", "value", 33.0, None),
]
# Used in place of the road flood rule where the flood layer varies in time.
FLOOD_CUTS_ROADS_RULE = ("road", "flood", "severity", 0.35, 0.7)
# (hazard, order, enabled): the order in which a shared cut is attributed.
ATTRIBUTION = [("surge", 0, True), ("flood", 1, False), ("wind", 2, True)]


def rule_table(spark: SparkSession, flood_cuts_roads: bool = False) -> DataFrame:
    """The rules as a table (a dozen rows); callers may pass their own instead."""
    rows = [
        FLOOD_CUTS_ROADS_RULE if flood_cuts_roads and r[:2] == ("road", "flood") else r
        for r in RULES
    ]
    return spark.createDataFrame(
        rows, "kind string, hazard string, metric string, at_risk double, cut double"
    )


def attribution_table(spark: SparkSession, flood_cuts_roads: bool = False) -> DataFrame:
    rows = [(h, o, e or (h == "flood" and flood_cuts_roads)) for h, o, e in ATTRIBUTION]
    return spark.createDataFrame(rows, "hazard string, ord int, enabled boolean")


def grade(value: Column, at_risk: Column, cut: Column) -> Column:
    """0 ok, 1 at risk, 2 cut; inclusive; a null threshold never fires."""
    return (
        F.when(F.coalesce(value >= cut, F.lit(False)), F.lit(CUT))
        .when(F.coalesce(value >= at_risk, F.lit(False)), F.lit(AT_RISK))
        .otherwise(F.lit(OK))
    )


def status_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUS]), code + 1)


def grade_by_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """df(kind, hazard, value, severity) with `status`; kinds without a rule stay ok.

    The rules are a constant-size table, so the planner broadcasts them.
    """
    metric = F.when(F.col("metric") == "severity", F.col("severity")).otherwise(F.col("value"))
    return (
        df.join(rules, ["kind", "hazard"], "left")
        .withColumn("status", grade(metric, F.col("at_risk"), F.col("cut")))
        .drop("metric", "at_risk", "cut")
    )


def link_kind(ferry: Column, connector: Column) -> Column:
    """Ferries and roads have rules; connectors never do."""
    return F.when(connector, F.lit("connector")).when(ferry, F.lit("ferry")).otherwise(F.lit("road"))


def way_status(links: DataFrame, keys: list[str]) -> DataFrame:
    """Worst status and highest value per way, independently."""
    return links.groupBy(*keys).agg(F.max("status").alias("status"), F.max("value").alias("value"))


def with_edge_status(features: DataFrame, ways: DataFrame, keys: list[str]) -> DataFrame:
    """A road's status from its links, or from its own geometry where the graph has none."""
    w = ways.select(*keys, F.col("status").alias("edge_status"), F.col("value").alias("edge_value"))
    return (
        features.join(w, keys, "left")
        .withColumn("status", F.coalesce("edge_status", "status"))
        .withColumn("value", F.coalesce("edge_value", "value"))
        .drop("edge_status", "edge_value")
    )


def link_masks(links: DataFrame, keys: list[str], order: DataFrame) -> DataFrame:
    """cut and at_risk per link over the isolating hazards; at_risk leaves out the cut ones."""
    on = order.filter("enabled").select("hazard", "ord")
    return (
        links.join(on, "hazard")
        .groupBy(*keys)
        .agg(
            F.bool_or(F.col("status") == CUT).alias("cut"),
            F.bool_or(F.col("status") == AT_RISK).alias("touched"),
            F.min_by("hazard", F.when(F.col("status") == CUT, F.col("ord"))).alias("cut_by"),
        )
        .withColumn("at_risk", F.col("touched") & ~F.col("cut"))
        .drop("touched")
    )


def affected(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per feature the worst status and what it came from (worst first, then hazard)."""
    return results.filter("status > 0").groupBy(*keys).agg(
        F.max("status").alias("worst"),
        F.min_by("hazard", F.struct(-F.col("status"), F.col("hazard"))).alias("worst_hazard"),
        F.count(F.lit(1)).alias("hazards"),
    )
