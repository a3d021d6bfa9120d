"""Repaired routes, intervals of use, block orders and replayed slices against direct computation."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from test_network import SCHEMA, graph

from stormledger.operators import impact as M
from stormledger.operators import network as N
from stormledger.operators import repair as R
from stormledger.operators import timeseries as TS
from stormledger.sources import results as SR
from stormledger.streaming.replay import slices


def damaged(spark, seed):
    rows = graph(70, 30, seed)
    r = random.Random(seed)
    links = spark.createDataFrame(rows, SCHEMA)
    sources = spark.createDataFrame([(7, 0), (8, 33), (9, 60)], "source long, node long")
    cuts = spark.createDataFrame([(s, x[0]) for s in range(6) for x in rows if r.random() < 0.05 * s], "step long, link_id long")
    return rows, links, sources, cuts


def test_repair_equals_routing_anew(spark):
    for seed in (3, 11):
        _, links, sources, cuts = damaged(spark, seed)
        tree = N.nearest_source(links, sources)
        every = sources.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
        want = {(r.step, r.node): (r.dist, r.source, r.via_node, r.via_link) for r in N.nearest_source(links, every, ["step"], cuts).collect()}
        lost = R.lost_nodes(tree, cuts, ["step"])
        anew = {(r.step, r.node): (r.dist, r.source, r.via_node, r.via_link) for r in R.repaired(links, tree, cuts, lost, ["step"]).collect()}
        gone = {(r.step, r.node) for r in lost.collect()}
        stored = {r.node: (r.dist, r.source, r.via_node, r.via_link) for r in tree.collect()}
        got = {(s, n): v for n, v in stored.items() for s in range(6) if (s, n) not in gone} | anew
        assert got == want and set(anew) <= gone
        off = {(r.step, r.node) for r in R.cut_off(links, tree, cuts, ["step"]).collect()}
        assert off == {(s, n) for s in range(6) for n in stored if (s, n) not in want}
        assert any(off) and any(anew)


def test_a_part_is_what_hangs_behind_one_cut(spark):
    chain = spark.createDataFrame([(k, k, k + 1, 0, False, 1.0) for k in range(9)], SCHEMA)
    tree = N.nearest_source(chain, spark.createDataFrame([(1, 0)], "source long, node long"))
    cuts = spark.createDataFrame([(1, 2), (1, 6), (2, 8)], "step long, link_id long")
    got = {(r.step, r.node): r.part for r in R.lost_nodes(tree, cuts, ["step"]).collect()}
    assert got == {(1, n): 3 if n < 7 else 7 for n in range(3, 10)} | {(2, 9): 9}
    assert R.cut_off(chain, tree, cuts.limit(0), ["step"]).count() == 0


def test_repaired_paths_add_up(spark):
    rows, links, sources, cuts = damaged(spark, 5)
    tree = N.nearest_source(links, sources)
    anew = R.repaired(links, tree, cuts, R.lost_nodes(tree, cuts, ["step"]), ["step"])
    there = {(r.step, r.node): r.dist for r in anew.collect()}
    starts = spark.createDataFrame([(s, k, n) for k, (s, n) in enumerate(sorted(there))], "step long, item long, node long")
    seconds, closed = {x[0]: x[5] for x in rows}, {(r.step, r.link_id) for r in cuts.collect()}
    walked = defaultdict(list)
    for r in R.repaired_paths(tree, anew, starts, ["step"]).collect():
        walked[r.step, r.item].append((r.pos, r.u, r.v, r.link_id))
    for k, (s, n) in enumerate(sorted(there)):
        hops = sorted(walked[s, k])
        assert [h[0] for h in hops] == list(range(len(hops))) and hops[0][1] == n
        assert all(a[2] == b[1] for a, b in zip(hops, hops[1:]))
        assert not any((s, h[3]) in closed for h in hops)
        assert abs(sum(seconds[h[3]] for h in hops) - there[s, n]) < 1e-9


def test_intervals_of_use_by_counting_every_step(spark):
    r = random.Random(1)
    departs = [(i, r.choice([None, *range(12)]), i % 5 == 0) for i in range(40)]
    route = [(i, w) for i in range(40) for w in r.sample(range(9), 4)]
    axis = spark.createDataFrame([("n", 2)], "network_id string, start long")
    d = spark.createDataFrame([(i, x, s, "n") for i, x, s in departs], "item long, deadline long, stays_open boolean, network_id string")
    d = d.filter("deadline IS NULL OR deadline >= 2")
    got = M.by_step(M.use_intervals(spark.createDataFrame(route, "item long, way_id long"), d, axis, ["way_id"])).collect()
    want = defaultdict(list)
    for i, x, stays in departs:
        if x is None or x < 2:
            continue
        for w in [w for j, w in route if j == i]:
            for t in range(2, x + 1):
                want[w, 0, t].append((x, i))
                if not stays and t >= x - 8:
                    want[w, 24, t].append((x, i))
    assert {(g.way_id, g.horizon_h, g.step): (g.facilities, g.earliest) for g in got} == {k: (len(v), min(v)[0]) for k, v in want.items()}
    sets = defaultdict(set)  # equal fingerprints for equal sets, and for no others
    for g in got:
        sets[g.facilities, g.f1, g.f2].add(frozenset(i for _, i in want[g.way_id, g.horizon_h, g.step]))
    assert all(len(s) == 1 for s in sets.values())


def order_by_hand(sequences):
    seen, edges = [], set()
    for seq in sequences:
        seen += [b for b in dict.fromkeys(seq) if b not in seen]
        edges |= {(a, b) for a, b in zip(seq, seq[1:]) if a != b}
    out = []
    while len(out) < len(seen):
        rest = [b for b in seen if b not in out]
        held = {b for a, b in edges if a in rest}
        out.append(next((b for b in rest if b not in held), rest[0]))
    return out


def test_block_orders_placed_one_by_one(spark):
    r = random.Random(6)
    roads = {f"r{k}": [r.sample("abcdefgh", r.randrange(1, 6)) for _ in range(r.randrange(1, 6))] for k in range(25)}
    roads["chain"] = [[f"b{i}", f"b{i + 1}"] for i in range(12)]
    roads["back"] = [[f"b{i + 1}", f"b{i}"] for i in range(8)]
    rows = [(road, n, i, b) for road, seqs in roads.items() for n, seq in enumerate(seqs) for i, b in enumerate(seq)]
    got = defaultdict(list)
    for x in M.block_order(spark.createDataFrame(rows, "road string, seq_no long, i long, block string")).orderBy("road", "pos").collect():
        got[x.road].append(x.block)
    assert dict(got) == {road: order_by_hand(seqs) for road, seqs in roads.items()}


def test_deadlines_keep_a_null_key(spark):
    rows = [(None, 1, True), (None, 3, False), (5, 1, True), (5, 2, True), (6, 1, False)]
    out = TS.deadlines(spark.createDataFrame(rows, "item long, step long, open boolean"), ["item"], "step", "open").collect()
    assert {(r.item, r.deadline, r.stays_open) for r in out} == {(None, 1, False), (5, 2, True), (6, None, False)}


def test_manifests_held_against_a_list(spark):
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/files"
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c"), (3, 4, "d")], "chunk long, k long, line string")
    bodies = {r.chunk: r.body for r in SR.write_manifests(rows, "chunk", "k", "line", path).collect()}
    assert bodies == {1: "a\nb\n", 2: "c\n", 3: "d\n"}
    import hashlib

    listed = spark.createDataFrame([("1", hashlib.sha256(b"a\nb\n").hexdigest()), ("2", "0"), ("9", "1")], "key string, listed string")
    got = {r.key: r.verdict for r in SR.held_against(SR.file_hashes(spark, path, "chunk=([0-9]+)/"), listed).collect()}
    assert got == {"1": "ok", "2": "changed", "3": "unlisted", "9": "missing"}


def test_slices_hold_every_row_in_order(spark):
    df = spark.createDataFrame([(k, None if k == 5 else k * k) for k in range(20)], "id long, at long")
    parts = [{r.id for r in p.collect()} for p in slices(df, "at", 4)]
    assert sum(map(len, parts)) == 20 and set.union(*parts) == set(range(20)) and 5 in parts[0]
    assert max(parts[0] - {5}) < min(parts[3])
    assert len(slices(df.limit(0), "at", 4)) == 1
