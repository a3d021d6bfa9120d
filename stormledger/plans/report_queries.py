"""Rules and reports over rows derived from the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormledger.functions import clock as C
from stormledger.operators import impact as M
from stormledger.operators import payout as PO
from stormledger.operators import quality as Q
from stormledger.operators import spatial as S
from stormledger.plans import inputs as I
from stormledger.plans import network_queries as NQ
from stormledger.plans.registry import query
from stormledger.plans.source_queries import link_users, scratch
from stormledger.sources import results as SR


@query(
    "off_axis",
    """WITH d AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS step FROM events)
       SELECT o_orderkey, o_custkey % 45 AS step FROM orders WHERE o_custkey % 45 NOT IN (SELECT step FROM d)""",
)
def off_axis(spark, sf):
    """Orders whose step is none of the event days."""
    rows = I.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 45).alias("step"))
    return C.off_axis(rows, NQ.days(spark, sf), ["step"])


@query(
    "lead_buckets",
    """WITH e AS (SELECT o_orderkey AS id, o_custkey AS item, o_orderkey % 30 AS step, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 9 * 3 END AS hours FROM orders),
       d AS (SELECT c_custkey AS item, c_custkey % 30 AS deadline FROM customer WHERE c_custkey % 4 > 0),
       l AS (SELECT e.id, e.item, e.step, CASE WHEN deadline IS NOT NULL THEN greatest(0, (deadline - step) * 3) ELSE hours END AS hours_left, coalesce(step > deadline, false) AS boat_only
             FROM e LEFT JOIN d ON d.item = e.item)
       SELECT id, item, step, hours_left, CASE WHEN hours_left <= 3 THEN 'soon' WHEN hours_left <= 12 THEN 'within12' ELSE 'later' END AS bucket, boat_only FROM l""",
)
def lead_buckets(spark, sf):
    k = F.col("o_orderkey")
    e = I.table(spark, sf, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("item"), (k % 30).alias("step"), F.when(k % 5 > 0, k % 9 * 3).alias("hours_remaining"))
    c = F.col("c_custkey")
    d = I.table(spark, sf, "customer").select(c.alias("item"), F.when(c % 4 > 0, c % 30).alias("deadline"))
    return M.lead_buckets(e, d).select("id", "item", "step", "hours_left", "bucket", "boat_only")


@query(
    "isolation_cuts",
    NQ.recursive("isolated", using_key=NQ._BASE)
    + "SELECT step, item, hazard, CASE WHEN way_id % 3 = 0 THEN 'road-' || way_id ELSE 'road-way-' || way_id END AS cut_id FROM isolated",
)
def isolation_cuts(spark, sf):
    """The cut that a pathway names in its second step."""
    return M.isolations(NQ.isolation_pathways(spark, sf).withColumn("status", F.lit("isolated")), ["step", "item"])


@query(
    "dq_rings",
    """WITH r AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, p_size FROM part)
       SELECT k AS key, unnest(list_filter([CASE WHEN kind = 1 THEN 'ring_size' END, CASE WHEN kind IN (1, 2) THEN 'ring_closed' END, CASE WHEN p_size > 40 THEN 'in_box' END], lambda x: x IS NOT NULL)) AS rule FROM r""",
)
def dq_rings(spark, sf):
    """Rings of parts: some of three points, some left open, some reaching out of the box."""
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z = F.lit(0.0)
    three, end = F.array(pt(z, z), pt(s, z), pt(s, F.lit(1.0))), F.array(pt(z, z))
    ring = F.when(k == 1, three).when(k == 2, F.concat(three, F.array(pt(z, F.lit(1.0))))).otherwise(F.concat(three, end))
    rows = I.table(spark, sf, "part").select("p_partkey", ring.alias("ring"))
    return Q.violations(rows, F.col("p_partkey"), Q.ring_rules("ring", (0.0, 0.0, 40.0, 1.0)))


@query(
    "top_links",
    """WITH l AS (SELECT p_partkey AS link, CASE WHEN p_size % 3 > 0 THEN p_name || ';x' END AS name, CASE WHEN p_type = 'LARGE' THEN 'ferry' ELSE 'road' END AS t, p_brand AS b FROM part),
       k AS (SELECT *, trim(string_split(name, ';')[1]) AS shown FROM l),
       e AS (SELECT *, CASE WHEN t = 'road' AND shown IS NOT NULL THEN 'road:' || shown WHEN shown IS NULL THEN 'unnamed|' || t || '|' || b || '|' || b || '|0' ELSE 'link:' || link END AS entry,
         coalesce(shown, CASE t WHEN 'ferry' THEN 'Unnamed ferry route' ELSE 'Unnamed road' END) AS label FROM k),
       g AS (SELECT entry, min(label) AS label, min(t) AS link_type, count(DISTINCT link) AS segments, count(DISTINCT l_suppkey) AS facility_count, min(l_suppkey % 20) AS earliest_deadline
             FROM e JOIN lineitem ON l_partkey = link GROUP BY 1)
       SELECT * FROM g ORDER BY facility_count DESC, earliest_deadline, link_type <> 'ferry', label, entry LIMIT 5""",
)
def top_links(spark, sf):
    return M.top_links(M.grouped_links(*link_users(spark, sf)))


@query(
    "largest_expected_tier",
    """WITH t AS (SELECT l_suppkey AS zone_id, l_linenumber::BIGINT AS step, (l_partkey % 3)::INTEGER AS released, (l_orderkey % 4)::INTEGER AS expected, l_extendedprice AS payout FROM lineitem)
       SELECT step, x.z AS zone_id, x.e AS expected_tier FROM (SELECT step, arg_max({'z': zone_id, 'e': expected}, (expected, payout, -zone_id)) AS x FROM t WHERE released = 0 AND expected > 0 GROUP BY 1)""",
)
def largest_expected_tier(spark, sf):
    rows = I.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("zone_id"), F.col("l_linenumber").cast("long").alias("step"),
        (F.col("l_partkey") % 3).cast("int").alias("released_tier"), (F.col("l_orderkey") % 4).cast("int").alias("expected_tier"),
        F.col("l_extendedprice").alias("payout"))
    return PO.largest_expected(rows, ["step"])


_STAND_INS = {"school_proxy": 0, "college_proxy": 1}


@query(
    "stand_in_dedupe",
    """WITH RECURSIVE r AS (SELECT c_custkey AS id, ['school_proxy', 'college_proxy', 'cyclone_shelter'][c_custkey % 3 + 1] AS kind, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS name,
           c_custkey % 2 = 0 AS is_area, c_custkey * 7919 % 2000 AS x, c_custkey * 104729 % 2000 AS y FROM customer),
         p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY kind = 'college_proxy', NOT is_area, id) AS i FROM (
             SELECT *, coalesce('name:' || lower(name), 'kind:' || kind) AS k FROM r WHERE kind <> 'cyclone_shelter')),
         g AS (SELECT k, 0::BIGINT AS i, [{'id': -1::BIGINT, 'x': -1000000::BIGINT, 'y': 0::BIGINT}] AS kept FROM p GROUP BY k UNION ALL
           SELECT g.k, p.i, CASE WHEN len(list_filter(g.kept, lambda q: (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 2500)) > 0
             THEN g.kept ELSE list_append(g.kept, {'id': p.id, 'x': p.x, 'y': p.y}) END FROM g JOIN p ON p.k = g.k AND p.i = g.i + 1),
         l AS (SELECT k, arg_max(kept, i) AS kept FROM g GROUP BY k)
       SELECT id, kind FROM r WHERE kind = 'cyclone_shelter' UNION ALL
       SELECT p.id, p.kind FROM p JOIN l ON l.k = p.k WHERE len(list_filter(l.kept, lambda q: q.id = p.id)) > 0""",
)
def stand_in_dedupe(spark, sf):
    k = F.col("c_custkey")
    kinds = F.array(*[F.lit(x) for x in ("school_proxy", "college_proxy", "cyclone_shelter")])
    rows = I.table(spark, sf, "customer").select(
        k.alias("id"), F.element_at(kinds, (k % 3 + 1).cast("int")).alias("kind"),
        F.when(k % 5 > 0, F.lower("c_mktsegment")).alias("name_key"), (k % 2 == 0).alias("is_area"),
        (k * 7919 % 2000).cast("double").alias("x"), (k * 104729 % 2000).cast("double").alias("y"))
    return S.dedupe_stand_ins(rows, _STAND_INS).select("id", "kind")


_CHUNK = 8


@query(
    "file_hashes",
    f"""WITH c AS (SELECT s_suppkey // {_CHUNK} AS chunk, string_agg(s_suppkey || chr(9) || s_name, chr(10) ORDER BY s_suppkey) || chr(10) AS body FROM supplier GROUP BY 1)
        SELECT chunk, octet_length(encode(body))::BIGINT AS length, sha256(body) AS sha256, CASE WHEN chunk % 5 = 4 THEN 'changed' WHEN chunk % 7 = 6 THEN 'unlisted' ELSE 'ok' END AS verdict FROM c""",
)
def file_hashes(spark, sf):
    """Manifest files of many suppliers each, hashed from their bytes and held against a list, of which some entries are wrong or missing."""
    path = scratch(spark, "files")
    s = I.table(spark, sf, "supplier").select(
        F.floor(F.col("s_suppkey") / _CHUNK).cast("long").alias("chunk"), F.col("s_suppkey").alias("k"),
        F.concat(F.col("s_suppkey").cast("string"), F.lit("\t"), "s_name").alias("value"))
    body = SR.write_manifests(s, "chunk", "k", "value", path)
    listed = body.filter("chunk % 7 <> 6 OR chunk % 5 = 4").select(
        F.col("chunk").cast("string").alias("key"), F.sha2(F.concat("body", F.when(F.col("chunk") % 5 == 4, "?").otherwise("")), 256).alias("listed"))
    return SR.held_against(SR.file_hashes(spark, path, "chunk=([0-9]+)/"), listed).select(
        F.col("key").cast("long").alias("chunk"), "length", "sha256", "verdict")
