"""Severity bounds, thresholds, and published scores recomputed from their parts."""

import pytest
from pyspark.sql import functions as F

from stormledger.functions import hazard as H
from stormledger.functions import labels as L
from stormledger.operators import grading as G
from stormledger.operators import payout as P
from stormledger.operators import quantile as Q
from stormledger.operators import risk as R
from stormledger.operators import timeseries as TS


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_severities_meet_their_breakpoints(spark):
    w = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 10.0, 17.0, 24.0, 33.0, 48.0, 60.0)], "v double")
    assert one(w, H.wind_severity(F.col("v"))) == [0.0, 0.0, 0.2, 0.35, 0.55, 0.75, 1.0, 1.0]
    s = spark.createDataFrame([(v,) for v in (0.0, 0.3, 1.0, 2.5, 4.0, 6.0)], "v double")
    assert one(s, H.surge_severity(F.col("v"))) == [0.0, 0.15, 0.4, 0.75, 1.0, 1.0]


def test_shape_parameter_is_bounded(spark):
    d = spark.createDataFrame([(900.0, 70.0), (1005.0, 15.0), (1012.0, 30.0)], "p double, v double")
    assert all(1.0 <= b <= 2.5 for b in one(d, H.shape_b(F.col("p"), F.col("v"))))


@pytest.mark.parametrize("value,expected", [(0.149, 0), (0.15, 1), (0.299, 1), (0.3, 2)])
def test_grading_is_inclusive(spark, value, expected):
    d = spark.createDataFrame([(value,)], "v double")
    assert one(d, G.grade(F.col("v"), F.lit(0.15), F.lit(0.3))) == [expected]
    assert one(d, G.grade(F.col("v"), F.lit(None).cast("double"), F.lit(None).cast("double"))) == [0]


def test_flood_rule_switch(spark):
    d = spark.createDataFrame([("road", "flood", 0.0, 0.8)], "kind string, hazard string, value double, severity double")
    assert one(G.grade_by_rules(d, G.rule_table(spark)), "status") == [1]
    assert one(G.grade_by_rules(d, G.rule_table(spark, flood_cuts_roads=True)), "status") == [2]


# Two published zones (parts rounded to 4 places, so scores agree to 1e-4).
ZONES = [
    ("A", 0.0, 0.1917, 0.3016, 0.0, 0.0, 0.0, 0.9177, 0.0424, 0.0, 0.9432, 0.0429, "population_density", "direct"),
    ("B", 0.0346, 0.5356, 0.414, 0.0, 0.0824, 0.0, 0.6826, 0.1176, 0.0, 0.7026, 0.1029, "population_density", "direct"),
]
NAMES = (
    "id string, surge double, wind double, flood double, isolated_facilities double, cut_roads double, cut_substations double, "
    "population_density double, hospital_access double, low_literacy double, mapped_shelters double, want double, driver string, how string"
)


def test_published_scores(spark):
    for r in R.composite(spark.createDataFrame(ZONES, NAMES)).collect():
        assert abs(r.score - r.want) < 1e-4 and r.top_driver == r.driver and r.reach == r.how


def test_driver_falls_back_to_hazard_and_to_null(spark):
    rows = [("A", 0.2, 0.1, 1.0, *[0.0] * 7, 0, "", ""), ("B", *[0.0] * 10, 0, "", "")]
    out = {r.id: r for r in R.composite(spark.createDataFrame([tuple(map(lambda x: float(x) if x == 0 else x, r)) for r in rows], NAMES)).collect()}
    assert out["A"].score == 0 and out["A"].top_driver is None and out["B"].top_driver is None
    d = spark.createDataFrame([(0.2, 0.1, 1.0, *[0.0] * 7, 0.5)], "surge double, wind double, flood double, isolated_facilities double, cut_roads double, cut_substations double, population_density double, hospital_access double, low_literacy double, mapped_shelters double, score double")
    assert one(d, R.top_driver()) == ["surge"]


@pytest.mark.parametrize("values,reading", [([5.0], 5.0), ([1.0, 9.0], 1.0), ([1, 2, 3, 4, 5], 4), (list(range(1, 12)), 10), ([7.0] * 4, 7.0)])
def test_reading_is_never_the_lone_highest(spark, values, reading):
    d = spark.createDataFrame([("z", float(v)) for v in values], "k string, v double")
    assert one(Q.lower_percentile(d, ["k"], "v"), "reading") == [float(reading)]


def test_median_accepts_infinity(spark):
    inf = float("inf")
    d = spark.createDataFrame([("a", 1.0), ("a", inf), ("b", 1.0), ("b", 2.0), ("b", inf)], "k string, v double")
    assert dict(Q.exact_median(d, ["k"], "v").collect()) == {"a": inf, "b": 2.0}


def test_governing_metric(spark):
    d = spark.createDataFrame([(33.0, 0.9), (33.0, 1.0), (34.0, 1.5), (46.0, 1.0), (0.0, 0.0)], "wind_ms double, surge_m double")
    got = [(r.metric, r.tier) for r in P.govern(d).collect()]
    assert got == [("wind_speed", 1), ("wind_speed", 1), ("surge_depth", 1), ("wind_speed", 2), ("wind_speed", 0)]


def test_ratchet_keeps_the_first_best(spark):
    d = spark.createDataFrame([("z", s, t, p) for s, (t, p) in enumerate([(0, 0.0), (2, 5.0), (1, 3.0), (2, 9.0), (3, 7.0)])], "k string, step int, tier int, payout double")
    got = [(r.released_tier, r.released_payout) for r in TS.ratchet(d, ["k"], "step", "tier", "payout").orderBy("step").collect()]
    assert got == [(0, 0.0), (2, 5.0), (2, 5.0), (2, 5.0), (3, 7.0)]


def test_expected_max_is_capped_and_independent_per_column(spark):
    d = spark.createDataFrame([("c", s, float(v), float(-v)) for s, v in enumerate([1, 5, 2, 0, 0, 0, 0, 0, 0, 0, 9])], "k string, step long, a double, b double")
    got = {r.step: (r.a, r.b) for r in TS.expected_max(d, ["k"], "step", ["a", "b"]).filter("horizon_h = 24").collect()}
    assert got[0] == (5.0, 0.0) and got[2] == (9.0, 0.0) and got[10] == (9.0, -9.0)


def test_runs_and_deadlines(spark):
    d = spark.createDataFrame([("f", 0, False), ("f", 1, True), ("f", 2, True), ("f", 4, True), ("g", 0, True), ("h", 0, False)], "k string, step int, iso boolean")
    got = {(r.k, r.step): r.since for r in TS.running_since(d, ["k"], "step", "iso", "step").collect()}
    assert got == {("f", 1): 1, ("f", 2): 1, ("f", 4): 4, ("g", 0): 0}
    dl = {r.k: (r.deadline, r.stays_open) for r in TS.deadlines(d.withColumn("open", ~F.col("iso")), ["k"], "step", "open").collect()}
    assert dl == {"f": (0, False), "g": (None, False), "h": (0, True)}


def test_formats(spark):
    d = spark.range(1)
    assert one(d, L.crore(F.lit(182800000))) == ["₹18.28 crore"]
    assert one(d, L.crore(F.lit(12345000000))) == ["₹1,234.50 crore"]
    assert one(d, F.array(*[L.people(F.lit(n)) for n in (0, 420, 8400, 123456)])) == [["0", "<1,000", "~8,000", "~1.2 lakh"]]
    assert one(d, F.array(L.duration(F.lit(3900)), L.duration(F.lit(420)))) == [["1 h 05 min", "7 min"]]
    assert one(d, L.voltage(F.lit("132000;33000;n/a"))) == ["132 kV / 33 kV / n/a"]


def test_exact_sums_hold_in_any_order_and_need_no_decimals_a_row(spark):
    from stormledger.operators import risk as R

    values = [(k % 3, v) for k, v in enumerate([3.4e6, 0.1234565, 2.5e-7, 1e9 + 1 / 3, 0.0, 17.0, 8e12, 4.4e-7, 123456.789012])]
    df = spark.createDataFrame(values, "g int, v double")
    made = df.groupBy("g").agg(R._exact_sum(F.col("v")).alias("s"))
    want = df.groupBy("g").agg(F.sum((F.floor(F.col("v") * 1e6 + 0.5) / 1e6).cast("decimal(24,6)")).cast("double").alias("s"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    assert "sum(cast" not in made._jdf.queryExecution().optimizedPlan().toString().lower()


def test_status_unfolds_horizons_after_the_join(spark):
    from conftest import SF

    from stormledger.operators import timeseries as TS
    from stormledger.plans.risk_queries import infra_status

    layer = spark.range(40).select(
        F.col("id").alias("cell_id"), F.lit(1).alias("step"), (F.col("id") * 1.0).alias("wind"), (F.col("id") % 7 / 10).alias("surge"),
        (F.col("id") * 2.0).alias("wind_ahead"), (F.col("id") % 9 / 10).alias("surge_ahead"))
    names = ["infra_id", "step", "horizon_h", "status"]
    late = infra_status(spark, SF, layer).select(names)
    early = infra_status(spark, SF, TS.unfold_horizons(layer, ["wind", "surge"])).select(names)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect()))
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_readings_without_the_next_day_are_those_of_horizon_0(spark):
    from conftest import SF
    from stormledger.operators import payout
    from stormledger.plans import inputs as I
    from stormledger.plans import risk_queries as Q
    from stormledger.plans.hazard_queries import hazard_cells

    rest = (I.overlap(spark, SF).drop("event"), I.zones(spark, SF), ["event", "step"], I.zone_steps(spark, SF))
    now = payout.readings(hazard_cells(spark, SF), *rest)
    full = Q.zone_readings(spark, SF).filter("horizon_h = 0")
    assert sorted(map(str, now.collect())) == sorted(map(str, full.collect())) and now.count() > 0
    assert "wind_ahead" not in Q._released(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_link_groups_count_repeated_users_once_in_one_aggregation(spark):
    from stormledger.operators import impact
    from conftest import SF
    from stormledger.plans.source_queries import link_users

    links = spark.createDataFrame(
        [(1, "A;x", "road"), (2, "A", "road"), (3, None, "ferry"), (4, "B", "ferry")], "link long, name string, link_type string"
    ).selectExpr("*", "'p' AS first_block", "'q' AS last_block", "0 AS f1")
    users = spark.createDataFrame([(1, 7, 5), (2, 7, 3), (2, 8, 9), (2, 8, 9), (3, 7, 1), (4, 9, 2)], "link long, item long, deadline long")
    got = {r.entry: (r.segments, r.facility_count, r.earliest_deadline) for r in impact.grouped_links(links, users).collect()}
    assert got == {"road:A": (2, 2, 3), "unnamed|ferry|p|q|0": (1, 1, 1), "link:4": (1, 1, 2)}
    assert "distinct" not in impact.grouped_links(*link_users(spark, SF))._jdf.queryExecution().analyzed().toString().lower()


def test_zone_facts_neither_store_nor_shuffle_the_layer(spark, monkeypatch):
    """Rows of cells and steps are summed up where the cells lie: above the window of the layer there is one
    exchange, that of partial sums, whatever the sizes."""
    from conftest import SF
    from stormledger import session
    from stormledger.plans import load_all
    from stormledger.plans.registry import QUERIES

    load_all()
    stored, save = [], session.WorkTables.save
    monkeypatch.setattr(session.WorkTables, "save", lambda self, df: stored.append(df) or save(self, df))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES["zone_facts"](spark, SF)
        plans = [df._jdf.queryExecution().executedPlan().toString().splitlines() for df in stored]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    layers = [p for p in plans if any("Window" in x for x in p)]
    assert len(layers) == 2 and all(any("SortMergeJoin" in x for x in p) for p in layers)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for lines in layers:
        at = next(i for i, x in enumerate(lines) if "Window" in x)
        above, low = [], depth(lines[at])
        for x in reversed(lines[:at]):
            if depth(x) < low:
                above.append(x)
                low = depth(x)
        exchanges = [i for i, x in enumerate(above) if "Exchange" in x]
        assert len(exchanges) == 1 and "partial_" in above[exchanges[0] - 1], above


def test_cells_are_placed_in_parts_of_bounded_size(spark):
    from conftest import SF
    from stormledger.plans import inputs as I

    placed = spark.range(1000).withColumnRenamed("id", "k")
    before = I.spread(placed, "k").rdd.getNumPartitions()
    assert I.spread(placed, "k", per_task=10).rdd.getNumPartitions() == 100 > before
    assert I.spread(placed, "k", per_task=1000).rdd.getNumPartitions() == before
    many, few = I.cells(spark, SF, 3), I.cells(spark, SF)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
