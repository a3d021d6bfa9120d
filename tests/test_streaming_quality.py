"""Streams against their batch twins, and checks on skewed keys."""

import tempfile

import pytest
from pyspark.sql import functions as F

from stormledger.operators import quality as Q
from stormledger.operators import timeseries as TS
from stormledger.streaming import streams as T


@pytest.fixture
def drained(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = []

    def run(frames, schema, make, mode):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for i, rows in enumerate(frames):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        name = f"out{len(names)}_{abs(hash(folder)) % 10**8}"
        names.append(name)
        q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
        q.awaitTermination(240)
        return spark.table(name)

    return run


def test_ratchet_stream_equals_batch(spark, drained):
    schema = "zone_id long, step long, tier int, payout double"
    frames = [[(1, 0, 0, 0.0), (2, 0, 1, 5.0)], [(1, 1, 2, 8.0), (2, 1, 0, 0.0)], [(1, 2, 1, 4.0), (2, 2, 3, 9.0)]]
    out = drained(frames, schema, T.ratchet_stream, "update")
    got = {r.zone_id: (r.t, r.p) for r in out.groupBy("zone_id").agg(F.max("released_tier").alias("t"), F.max_by("released_payout", "released_tier").alias("p")).collect()}
    batch = TS.ratchet(spark.createDataFrame([r for f in frames for r in f], schema), ["zone_id"], "step", "tier", "payout")
    want = {r.zone_id: (r.released_tier, r.released_payout) for r in batch.filter("step = 2").collect()}
    assert got == want


def test_first_moment_stream_emits_once(spark, drained):
    out = drained([[("a", 5)], [("a", 3), ("b", 1)], [("b", 0)]], "kind string, step long", T.first_moment_stream, "append")
    assert sorted(map(tuple, out.collect())) == [("a", 5), ("b", 1)]


def test_expected_stream_equals_the_forward_maximum(spark, drained):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [("c", day + dt.timedelta(hours=3 * i), float(v)) for i, v in enumerate([1, 5, 2, 0, 7, 0, 0, 0, 3, 0, 9, 0, 0])]
    late = [("c", day + dt.timedelta(days=9), 0.0)]  # moves the watermark past every window
    out = drained([rows, late], "cell_id string, ts timestamp, value double", T.expected_stream, "append")
    got = {r.ts: r.value for r in out.collect() if r.ts >= day}
    for i, (_, ts, _v) in enumerate(rows):
        assert got[ts] == max(v for _, _, v in rows[i : i + 9])


def test_rate_stream(spark, drained):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1, 10, 0)
    rows = [(t0 + dt.timedelta(minutes=m),) for m in (0, 10, 50, 70)] + [(t0 + dt.timedelta(days=1),)]
    out = drained([rows], "ts timestamp", lambda s: T.dispatch_rate_stream(s, 3), "append")
    at = {r.start: (r.n, r.limited) for r in out.collect()}
    assert at[t0] == (3, True) and at[t0 + dt.timedelta(minutes=11)] == (2, False)


def test_trailing_count_on_one_hot_key(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else "cold", t0 + dt.timedelta(seconds=i * 401)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    got = {r.id: r.in_hour for r in T.trailing_count(df, "k", "ts", "id", 3600).collect()}
    for i, k, ts in rows:
        assert got[i] == sum(1 for _, kk, t in rows if kk == k and ts - dt.timedelta(hours=1) < t <= ts)


def test_chunked_lag_equals_lag(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), (F.col("id") * 7).alias("v")).filter("o % 11 <> 0 AND (o < 200 OR o > 330)")
    df.createOrReplaceTempView("lag_rows")
    want = {r.o: r.p for r in spark.sql("select o, lag(v) over (partition by k order by o) p from lag_rows").collect()}
    got = {r.o: r.prev for r in Q.chunked_lag(df, ["k"], "o", "v", 20).collect()}
    assert got == want


def test_rules_transitions_and_rings(spark):
    log = spark.createDataFrame([(1, 1, "created"), (1, 2, "approved"), (1, 3, "sent"), (1, 4, "edited"), (2, 1, "approved")], "a long, id long, action string")
    moves = spark.createDataFrame(Q.TRANSITIONS, "before string, after string")
    assert [(r.a, r.id) for r in Q.illegal_moves(log, ["a"], "id", "action", moves).orderBy("a").collect()] == [(1, 4), (2, 1)]
    assert {r.a: r.state for r in Q.latest_state(log, ["a"], "id", "action").collect()} == {1: "edited", 2: "approved"}
    rings = spark.createDataFrame(
        [(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (2, [(0.0, 0.0), (1.0, 0.0), (9.0, 1.0)])], "id long, ring array<struct<x: double, y: double>>"
    )
    got = sorted((r.key, r.rule) for r in Q.violations(rings, F.col("id"), Q.ring_rules("ring", (0, 0, 1, 1))).collect())
    assert got == [(2, "in_box"), (2, "ring_closed"), (2, "ring_size")]
    totals = spark.createDataFrame([("d", 0, 1.0), ("d", 1, 3.0), ("d", 2, 2.0)], "k string, step int, v double")
    assert [r.step for r in Q.falling_totals(totals, ["k"], "step", "v").collect()] == [2]
    res = spark.createDataFrame([(1, "ok", ["x"], None), (2, "approved", [], None), (3, "cut", ["x"], "A")], "id long, status string, pathway array<string>, approved_by string")
    assert sorted((r.key, r.rule) for r in Q.violations(res, F.col("id"), Q.result_rules()).collect()) == [(1, "ok_without_pathway"), (2, "approver_named")]
