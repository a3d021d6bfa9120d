"""The eight-node scenario network, skewed hubs, and brute-force checks of the loops."""

import heapq
import random

from pyspark.sql import functions as F

from stormledger.functions.ranking import grouped_row_number
from stormledger.operators import impact as M
from stormledger.operators import network as N

# A..H = 0..7; way 5 is a ferry (3-4); way 6 joins 6-7 and is apart from the anchor's component.
LINKS = [
    (10, 0, 1, 1, False, 100.0), (20, 1, 2, 2, False, 100.0), (30, 2, 3, 3, False, 100.0),
    (40, 1, 5, 4, False, 100.0), (50, 3, 4, 5, True, 300.0), (60, 6, 7, 6, False, 50.0),
]
SCHEMA = "link_id long, u long, v long, way_id long, ferry boolean, tt double"


def scenario(spark):
    return spark.createDataFrame(LINKS, SCHEMA).withColumn("connector", F.lit(False)).withColumn("network_id", F.lit("n"))


def isolate(spark, cut_rows):
    links = scenario(spark)
    cuts = spark.createDataFrame(cut_rows, "step long, link_id long, cut_by string")
    steps = cuts.select(F.lit("n").alias("network_id"), "step").distinct()
    facilities = spark.createDataFrame([(1, 3, False), (2, 4, False), (3, 7, False), (4, 4, True)], "item long, node long, too_far boolean")
    tree = N.nearest_source(links, spark.createDataFrame([(0, 0)], "source long, node long"))
    hops = N.paths(tree, facilities)
    reach = N.reachable(links, cuts.drop("cut_by"), steps, 0, ["step"])
    out = M.isolation(facilities, links, cuts, reach, hops, ["step"])
    return {(r.step, r.item): (r.hazard, r.way_id) for r in out.collect()}


def test_isolation_cases(spark):
    got = isolate(spark, [(1, 30, "surge"), (2, 50, "wind"), (3, 30, "surge"), (3, 50, "wind"), (4, 40, "surge")])
    assert got == {
        (1, 1): ("surge", 3), (1, 2): ("surge", 3),  # road 3 cut: both behind it
        (2, 2): ("wind", 5),  # ferry stopped: only the far side
        (3, 1): ("surge", 3), (3, 2): ("wind", 5),  # the first cut on the usual path counts
    }  # never: item 3 (apart at baseline), item 4 (too far from the network)


def test_parallel_links_must_all_be_cut(spark):
    links = scenario(spark).unionByName(
        spark.createDataFrame([(31, 2, 3, 9, False, 50.0)], SCHEMA).withColumn("connector", F.lit(False)).withColumn("network_id", F.lit("n"))
    )
    hops = spark.createDataFrame([(1, 0, 3, 2), (1, 1, 2, 1)], "item long, pos int, u long, v long")
    cuts = spark.createDataFrame([(1, 30), (2, 30), (2, 31)], "step long, link_id long")
    got = [(r.step, r.link_id) for r in N.first_cut(hops, links, cuts, ["step"]).collect()]
    assert got == [(2, 31)]


def graph(n, extra, seed, hub=False):
    r = random.Random(seed)
    rows, k = [], 0
    for v in range(1, n):
        u = 0 if hub and v % 3 == 0 else r.randrange(v)
        if r.random() < 0.9:
            rows.append((k, min(u, v), max(u, v), k // 3, r.random() < 0.2, float(r.randrange(1, 9))))
            k += 1
    for _ in range(extra):
        u, v = r.randrange(n), r.randrange(n)
        if u != v:
            rows.append((k, min(u, v), max(u, v), k // 3, False, float(r.randrange(1, 9))))
            k += 1
    return rows


def dijkstra(rows, sources):
    adj = {}
    for _, u, v, _, _, t in rows:
        adj.setdefault(u, []).append((v, t))
        adj.setdefault(v, []).append((u, t))
    best, heap = {}, [(0.0, s, n) for s, n in sources]
    heapq.heapify(heap)
    while heap:
        d, s, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = (d, s)
        for m, t in adj.get(n, []):
            heapq.heappush(heap, (d + t, s, m))
    return best


def test_nearest_source_with_a_hub(spark):
    rows = graph(120, 60, 3, hub=True)
    links = spark.createDataFrame(rows, SCHEMA)
    sources = [(7, 5), (8, 50), (9, 100)]
    got = {r.node: (r.dist, r.source) for r in N.nearest_source(links, spark.createDataFrame(sources, "source long, node long")).collect()}
    want = dijkstra(rows, sources)
    assert got == want


def test_k_nearest_are_distinct(spark):
    rows = graph(60, 30, 4)
    links = spark.createDataFrame(rows, SCHEMA)
    sources = [(7, 5), (8, 50), (9, 5)]
    got = {}
    for r in N.k_nearest_sources(links, spark.createDataFrame(sources, "source long, node long"), 2).collect():
        got.setdefault(r.node, []).append((r.dist, r.source))
    singles = [{n: (d, s) for n, (d, s) in dijkstra(rows, [x]).items()} for x in sources]
    for n, found in got.items():
        want = sorted(x[n] for x in singles if n in x)[:2]
        assert sorted(found) == want


def test_components_of_long_chain_and_star(spark):
    chain = [(i, i, i + 1, 0, False, 1.0) for i in range(70)]
    star = [(100 + i, 200, 201 + i, 0, False, 1.0) for i in range(50)]
    c = N.components(spark.createDataFrame(chain + star, SCHEMA))
    sizes = {r.comp: r.n for r in c.groupBy("comp").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 71, 200: 51}


def test_simplify_keeps_ways_apart(spark):
    rows = [(1, 0, 1, 7, False, 1.0), (2, 1, 2, 7, False, 2.0), (3, 2, 3, 7, False, 3.0), (4, 3, 4, 8, False, 4.0), (5, 10, 11, 9, False, 1.0), (6, 11, 12, 9, False, 1.0), (7, 10, 12, 9, False, 1.0)]
    links = spark.createDataFrame(rows, SCHEMA).withColumn("connector", F.lit(False))
    got = sorted((r.u, r.v, r.way_id, r.tt, r.pieces) for r in N.simplify(links).collect())
    assert got == [(0, 3, 7, 6.0, 3), (3, 4, 8, 4.0, 1), (10, 10, 9, 3.0, 3)]


def test_ferry_ends_and_islands(spark):
    links = scenario(spark)
    assert {r.node for r in N.ferry_ends(links).collect()} == {3, 4}
    assert {r.node for r in N.stranded_ferry_ends(links).collect()} == {4}
    places = spark.createDataFrame([("far", 4), ("near", 2), ("apart", 7)], "place string, node long")
    got = {r.place: (r.joined, r.via_ferry) for r in N.island_links(links, places, 0).collect()}
    assert got == {"far": (True, True), "near": (True, False), "apart": (False, False)}


def test_departures(spark):
    links = scenario(spark)
    steps = spark.createDataFrame([("n", s) for s in range(4)], "network_id string, step long")
    cuts = spark.createDataFrame([(2, 50), (3, 50), (0, 20)], "step long, link_id long")
    f = spark.createDataFrame([(1, 4, False, "n"), (2, 5, False, "n"), (3, 7, False, "n"), (4, 4, True, "n")], "item long, node long, too_far boolean, network_id string")
    safe = spark.createDataFrame([(90, 0, "n"), (91, 3, "n")], "source long, node long, network_id string")
    d, hops = M.departures(f, links, cuts, safe, steps)
    got = {r.item: (r.deadline, r.stays_open, r.source, r.travel_time_s, r.uses_ferry) for r in d.collect()}
    assert got[1] == (1, False, 91, 300, True)
    assert got[2] == (3, True, 90, 200, False)
    assert got[3][0] is None and got[4][0] is None
    notes = {r.item: r.note for r in d.collect()}
    assert notes[3].startswith("No safe") and notes[4].startswith("More than 2 km") and notes[1] is None


def test_block_order_resolves_precedence_and_cycles(spark):
    seq = [("r", 0, 0, "b"), ("r", 0, 1, "c"), ("r", 1, 0, "a"), ("r", 1, 1, "b"), ("s", 0, 0, "x"), ("s", 0, 1, "y"), ("s", 1, 0, "y"), ("s", 1, 1, "x")]
    out = M.block_order(spark.createDataFrame(seq, "road string, seq_no long, i long, block string"))
    got = {}
    for r in out.orderBy("road", "pos").collect():
        got.setdefault(r.road, []).append(r.block)
    assert got == {"r": ["a", "b", "c"], "s": ["x", "y"]}


def test_grouped_row_number_matches_the_window(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 37 % 1009).alias("v"), "id")
    df.createOrReplaceTempView("ranked_rows")
    want = {r.id: r.n for r in spark.sql("select id, row_number() over (partition by k order by v, id) n from ranked_rows").collect()}
    got = {r.id: r.n for r in grouped_row_number(df, ["k"], [F.col("v"), F.col("id")], "n").collect()}
    assert got == want


def test_loops_leave_one_table(spark):
    import glob

    from stormledger.session import work_folder

    before = set(glob.glob(f"{work_folder(spark)}/components-*/*"))
    chain = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(20)], "link_id long, u long, v long, tt double")
    assert N.components(chain).select("comp").distinct().count() == 1
    assert len(set(glob.glob(f"{work_folder(spark)}/components-*/*")) - before) == 1


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from stormledger.session import work_folder

    class Jvm:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    class Session:
        master = "spark://somewhere:7077"
        _jsc = Jvm()
        conf = {}

        @property
        def sparkContext(self):
            return self

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(Session())


def test_only_the_anchor_s_component_is_worked_on(spark, monkeypatch):
    from stormledger.plans import network_queries as Q
    from conftest import SF

    whole = Q.links(spark, SF)
    home = {r.node for r in N.joined_nodes(whole, Q.ANCHOR).collect()}
    net = Q.Net(spark, SF)
    kept = {r.link_id for r in net.links.collect()}
    assert kept == {r.link_id for r in whole.collect() if r.u in home} and len(kept) < whole.count()
    assert {r.link_id for r in net.cuts.collect()} <= kept
    met, shown = [], N.components
    monkeypatch.setattr(N, "components", lambda links, scenario=None: met.append(links) or shown(links, scenario))
    Q.reach(spark, SF)
    assert all({r.u for r in links.collect()} <= home for links in met[1:])
    assert N.joined_nodes(whole, -5).count() == 0


def test_maps_of_components_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, save = [], N.WorkTables.save
    monkeypatch.setattr(N.WorkTables, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df))
    chain = spark.range(40).selectExpr("id AS u", "id + 1 AS v")
    assert {r.comp for r in N.components(chain).collect()} == {0}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
