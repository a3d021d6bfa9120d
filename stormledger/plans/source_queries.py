"""Sources and sinks: each query writes what Spark derives from the tables and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stormledger.functions import labels as L
from stormledger.functions.clock import step_time
from stormledger.functions.numeric import round_to
from stormledger.operators import hazard as OH
from stormledger.operators import impact as M
from stormledger.operators import network as N
from stormledger.operators import spatial as S
from stormledger.plans import inputs as I
from stormledger.plans.inputs import r_sql, with_ctes
from stormledger.plans.network_queries import links
from stormledger.plans.registry import query
from stormledger.plans.risk_queries import graded, infra
from stormledger.plans.spatial_queries import boxes, sites
from stormledger.plans.text_queries import tagged
from stormledger.session import work_folder
from stormledger.sources import features as SF
from stormledger.sources import results as SR
from stormledger.sources import track as ST


def scratch(spark, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query(
    "track_csv",
    with_ctes("buckets")
    + f"""SELECT event, step, {r_sql('15e0 + (v % 800) / 100e0', 4)} AS lat, {r_sql('84e0 + (v % 500) / 100e0', 4)} AS lon,
        {r_sql("(CASE WHEN v % 3 > 0 THEN v % 90 WHEN v % 5 > 0 THEN v % 70 WHEN v % 2 > 0 THEN v % 50 ELSE 65 END) * 0.514444e0", 2)} AS max_wind,
        {r_sql("CASE WHEN v % 4 > 0 THEN 940e0 + v % 61 ELSE 950e0 END", 1)} AS pressure, {r_sql("(CASE WHEN v % 7 > 0 THEN n % 30 + 5 ELSE 16 END) * 1.852e0", 1)} AS radius_km
        FROM buckets WHERE event <> 'view'""",
)
def track_csv(spark, sf):
    """Fixes written as best-track CSV (with its units row), read back and resampled."""
    b = I.event_buckets(spark, sf)
    v, n = F.col("v"), F.col("n")
    text = lambda cond, value: F.when(cond, value.cast("string")).otherwise(F.lit(""))
    at = F.date_format(step_time(F.col("step")), "yyyy-MM-dd HH:mm:ss")
    rows = b.select(
        F.concat(F.lit("S-"), "event").alias("SID"), F.col("event").alias("NAME"), at.alias("ISO_TIME"),
        text(v % 2 == 0, F.lit(15.0) + (v % 800) / 100.0).alias("LAT"), text(v % 2 == 0, F.lit(84.0) + (v % 500) / 100.0).alias("LON"),
        (F.lit(15.0) + (v % 800) / 100.0).cast("string").alias("NEWDELHI_LAT"), (F.lit(84.0) + (v % 500) / 100.0).cast("string").alias("NEWDELHI_LON"),
        F.lit("").alias("USA_LAT"), F.lit("").alias("USA_LON"),
        text(v % 3 > 0, v % 90).alias("WMO_WIND"), text(v % 5 > 0, v % 70).alias("NEWDELHI_WIND"), text(v % 2 > 0, v % 50).alias("USA_WIND"),
        F.lit("").alias("WMO_PRES"), text(v % 4 > 0, F.lit(940.0) + v % 61).alias("NEWDELHI_PRES"), F.lit("").alias("USA_PRES"),
        text(v % 7 > 0, n % 30 + 5).alias("USA_RMW"),
    )
    units = spark.range(1).select(*[F.lit("degrees").alias(c) for c in ST.COLUMNS])
    path = scratch(spark, "track")
    units.unionByName(rows).write.csv(path, header=True, quote='"', emptyValue="")
    storms = ST.of_storm(ST.read_track(spark, path), "click", ["S-error", "S-purchase", "S-signup"])
    return ST.resample(storms)


@query("kept_lines", "SELECT count(*) AS n FROM orders WHERE contains(o_orderpriority, 'HIGH') OR contains(o_orderpriority, 'LOW')")
def kept_lines(spark, sf):
    path = scratch(spark, "lines")
    I.table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", "o_orderpriority")).write.text(path)
    return ST.keep_lines(spark, path, ["HIGH", "LOW"]).agg(F.count(F.lit(1)).alias("n"))


@query(
    "track_lookup",
    with_ctes("fixes") + "SELECT event, step, CASE WHEN step % 5 = 0 THEN 20e0 ELSE lat END AS lat FROM fixes",
)
def track_lookup(spark, sf):
    f = I.fixes(spark, sf).select("event", "step", "lat")
    axis = f.select("event", "step")
    return ST.lookup(axis, f.filter("step % 5 <> 0"), axis.withColumn("lat", F.lit(20.0)), ["event", "step"], ["lat"])


@query("commented_csv", "SELECT lpad(c_custkey::VARCHAR, 8, '0') AS code, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer")
def commented_csv(spark, sf):
    path = scratch(spark, "blocks")
    k = F.col("c_custkey")
    rows = I.table(spark, sf, "customer").select(
        F.lpad(k.cast("string"), 8, "0").alias("code"), F.col("c_name").alias("name"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("segment")
    )
    lines = rows.select(F.explode(F.array(
        F.concat(F.lit("# row of "), "name"), F.concat_ws(",", "code", "name", F.coalesce("segment", F.lit("")))
    )).alias("value"))
    lines.write.text(path)
    return SF.read_commented(spark, path, ["code", "name", "segment"], header=False).drop("ord")


@query("geojson_features", with_ctes("towers") + "SELECT 'tower-' || tid AS id, tid AS key, tx::DOUBLE AS x, ty::DOUBLE AS y FROM towers")
def geojson_features(spark, sf):
    path = scratch(spark, "geojson")
    k = F.col("s_suppkey")
    I.table(spark, sf, "supplier").select(
        F.lit("Feature").alias("type"), F.concat(F.lit("tower-"), k.cast("string")).alias("id"), F.struct(k.alias("key")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array((k * 7561 % 40000).cast("double"), (k * 4409 % 40000).cast("double")).alias("coordinates")).alias("geometry"),
    ).write.json(path)
    rows = SF.read_geojson(spark, path, "key: bigint", "array<double>", multi_line=False)
    return rows.select("id", "key", F.element_at("geometry.coordinates", 1).alias("x"), F.element_at("geometry.coordinates", 2).alias("y"))


@query(
    "element_responses",
    """WITH k AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 6 IN (2, 5) THEN 'school_proxy' WHEN p_partkey % 6 = 3 THEN 'community_proxy' END AS kind FROM part)
       SELECT 'node' AS type, id, CASE WHEN id % 4 = 0 THEN 'assembly_point' ELSE kind END AS kind, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS response FROM k WHERE id % 4 = 0 OR kind IS NOT NULL""",
)
def element_responses(spark, sf):
    """Two overlapping responses; an element seen twice keeps its better kind, else the first."""
    k = F.col("p_partkey")
    amenity = F.element_at(F.array(*[F.lit(a) for a in ["pub", "bank", "school", "townhall", "cafe", "college"]]), (k % 6 + 1).cast("int"))
    part = I.table(spark, sf, "part")
    paths = []
    for i, rows in enumerate([part, part.filter(k % 4 == 0)]):
        tags = F.create_map(F.lit("amenity"), amenity, F.lit("emergency"), F.when(F.lit(i == 1), F.lit("assembly_point")))
        element = F.struct(F.lit("node").alias("type"), k.alias("id"), tags.alias("tags"))
        path = scratch(spark, f"response-{i}")
        rows.select(F.array(element).alias("elements")).write.json(path)
        paths.append(path)
    e = SF.read_elements(spark, *paths).withColumn("kind", L.shelter_kind(F.col("tags"))).filter("kind IS NOT NULL")
    return SF.best_copy(e).select("type", "id", "kind", "response")


@query("feature_parquet", with_ctes("infra") + "SELECT infra_id, name, zone_id FROM infra WHERE infra_type = 'hospital'")
def feature_parquet(spark, sf):
    path = scratch(spark, "infra")
    SF.write_features(infra(spark, sf), path)
    return SF.read_features(spark, path, "hospital").select("infra_id", "name", "zone_id")


@query(
    "road_index",
    "SELECT l.l_partkey AS way_id, count(*) AS uses, 'road-way-' || l.l_partkey AS road_id FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey AND p.p_type IN ('ECONOMY', 'LARGE') AND p.p_partkey % 2 = 0 GROUP BY 1",
)
def road_index(spark, sf):
    k = F.col("infra_id")
    osm = F.when(k % 2 == 0, F.concat(F.lit("way/"), k.cast("string"))).otherwise(F.concat(F.lit("node/"), k.cast("string")))
    f = infra(spark, sf).select("infra_type", osm.alias("osm_id"), SF.feature_id(F.col("infra_type"), F.lit("way"), k).alias("id"))
    uses = I.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("way_id")).agg(F.count(F.lit(1)).alias("uses"))
    return uses.join(SF.road_index(f), "way_id")


@query(
    "compact_roundtrip",
    with_ctes("graded")
    + """, g AS (SELECT l_partkey, hazard, max(status) AS s FROM graded GROUP BY 1, 2), f AS (SELECT p_partkey, unnest(['surge', 'wind', 'flood']) AS hazard FROM part)
        SELECT f.p_partkey AS l_partkey, f.hazard, CASE coalesce(g.s, 0) WHEN 2 THEN 'cut' WHEN 1 THEN 'at_risk' ELSE 'ok' END AS status FROM f LEFT JOIN g ON g.l_partkey = f.p_partkey AND g.hazard = f.hazard""",
)
def compact_roundtrip(spark, sf):
    from stormledger.operators.grading import status_name, way_status

    full = way_status(graded(spark, sf), ["l_partkey", "hazard"]).withColumn("status", status_name(F.col("status")))
    stored = SR.compact(full)
    parts = I.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"))
    return SR.expand(stored, parts, ["surge", "wind", "flood"], ["l_partkey"]).select("l_partkey", "hazard", "status")


@query(
    "content_dedup",
    """WITH x AS (SELECT DISTINCT o_custkey % 40 AS step, o_orderpriority AS p, o_orderstatus AS s FROM orders),
       k AS (SELECT step, string_agg(p || s, ',' ORDER BY p, s) AS c FROM x GROUP BY 1)
       SELECT x.step, x.p, x.s, (SELECT count(DISTINCT c) FROM k) AS contents FROM x""",
)
def content_dedup(spark, sf):
    """Results stored once per distinct content and restored per step."""
    x = I.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 40).alias("step"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")
    ).distinct()
    index, content = SR.dedup_content(x, "step", ["p", "s"])
    first = index.groupBy("content").agg(F.min("step").alias("first"))
    n = first.agg(F.count(F.lit(1)).alias("contents"), F.lit(1).alias("one"))
    rows = x.join(first.withColumnRenamed("first", "step"), "step")
    return SR.restore(index, rows.drop("step")).withColumn("one", F.lit(1)).join(n, "one").select("step", "p", "s", "contents")


@query("attached_geometry", with_ctes("cells") + "SELECT c_custkey AS cell_id, lat, lon, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o JOIN customer ON c_custkey = k JOIN cells ON cell_id = k")
def attached_geometry(spark, sf):
    facts = I.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"))
    good, unknown = SR.attach(facts, I.cells(spark, sf).select("cell_id", "lat", "lon"), "cell_id")
    return good.join(unknown.select("cell_id"), "cell_id", "left_anti").select("cell_id", "lat", "lon", "n")


@query(
    "html_extract_sum",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a [^>]*>[^<]*</a></li>')) AS row FROM pages), c AS (SELECT page_id, trim(regexp_replace(row, '<[^>]+>', '', 'g')) AS cell FROM l)
       SELECT page_id, count(*) AS rows, sum(length(cell))::BIGINT AS chars FROM c GROUP BY 1""",
)
def html_extract_sum(spark, sf):
    rows = SR.html_rows(I.table(spark, sf, "pages"), "html", r"<li><a [^>]*>[^<]*</a></li>", r"<a [^>]*>[^<]*</a>")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.element_at("cells", 1))).cast("long").alias("chars"))


@query(
    "html_table_sum",
    "SELECT p_partkey AS page_id, (p_size * 1001 + p_partkey)::BIGINT AS total FROM part",
)
def html_table_sum(spark, sf):
    """Tables of two four-cell rows and one of three cells; only the four-cell rows count."""
    k, s = F.col("p_partkey"), F.col("p_size")
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>\n"))
    x = F.lit("x")
    html = F.concat(
        F.lit("<p>t</p><table>\n"), row(x, x, x, F.concat(F.lit("<b>"), F.format_number(s * 1001, 0), F.lit("</b>"))),
        row(x, x, F.lit("7")), row(x, x, x, k.cast("string")), F.lit("</table><table>"), row(x, x, x, F.lit("9")), F.lit("</table>"),
    )
    return SR.table_sum(I.table(spark, sf, "part").select(k.alias("page_id"), html.alias("html")), "html")


@query(
    "bindings_of_year",
    "SELECT lpad(c_custkey::VARCHAR, 5, '0') AS code, (c_custkey * 10)::BIGINT AS population FROM customer WHERE c_custkey % 3 = 0",
)
def bindings_of_year(spark, sf):
    k = F.col("c_custkey")
    year = F.when(k % 3 == 0, F.lit("2011-03-01")).otherwise(F.lit("2001-03-01"))
    text = F.concat(
        F.lit('{"results": {"bindings": [{"code": {"value": "'), F.lpad(k.cast("string"), 5, "0"), F.lit('"}, "pop": {"value": "'), (k * 10).cast("string"),
        F.lit('.0"}, "time": {"value": "'), year, F.lit('"}}]}}'),
    )
    return SR.values_of_year(SR.bindings(I.table(spark, sf, "customer").select(text.alias("t")), "t", ["code", "pop", "time"]), "2011")


@query(
    "labels_by_language",
    "SELECT c_custkey AS code, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS bn, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS hi FROM customer",
)
def labels_by_language(spark, sf):
    k = F.col("c_custkey")
    rows = I.table(spark, sf, "customer").select(k.alias("code"), F.explode(F.filter(F.array(
        F.when(k % 2 == 0, F.struct(F.lit("bn").alias("lang"), F.concat("c_name", F.lit(" block")).alias("label"))),
        F.when(k % 3 == 0, F.struct(F.lit("hi").alias("lang"), F.concat("c_mktsegment", F.lit(" khand")).alias("label"))),
    ), lambda x: x.isNotNull())).alias("x")).select("code", "x.*")
    return SR.labels_by_language(rows, I.table(spark, sf, "customer").select(k.alias("code")), {"bn": " block", "hi": " khand"})


@query("way_edges", "SELECT p_partkey AS way_id, i AS seq, p_partkey + i - 1 AS u, p_partkey + i AS v, i::DOUBLE AS dx FROM (SELECT *, unnest(generate_series(1, p_size % 5 + 1)) AS i FROM part)")
def way_edges(spark, sf):
    k = F.col("p_partkey")
    steps = F.sequence(F.lit(0).cast("long"), (F.col("p_size") % 5 + 1).cast("long"))
    ways = I.table(spark, sf, "part").select(
        k.alias("id"), F.transform(steps, lambda i: k + i).alias("nodes"),
        F.transform(steps, lambda i: F.struct(F.lit(22.0).alias("lat"), i.cast("double").alias("lon"))).alias("geometry"),
    )
    return SF.way_edges(ways).select("way_id", F.col("seq").cast("long").alias("seq"), "u", "v", F.col("b.lon").alias("dx"))


@query("long_ferries", "SELECT p_partkey AS id FROM part WHERE NOT (p_type = 'LARGE' AND p_size >= 10)")
def long_ferries(spark, sf):
    """Ferries over 50 km are ships: parts of size n run n tenths of a degree along the equator."""
    k = F.col("p_partkey")
    pts = F.array(
        F.struct(F.lit(0.0).alias("lat"), F.lit(10.0).alias("lon")),
        F.struct(F.lit(0.0).alias("lat"), (F.lit(10.0) + F.col("p_size") * F.lit(0.0495)).alias("lon")),
    )
    ways = I.table(spark, sf, "part").select(k.alias("id"), (F.col("p_type") == "LARGE").alias("ferry"), pts.alias("geometry"))
    return N.drop_long_ferries(ways).select("id")


@query("network_tables", with_ctes("links") + "SELECT u, v, tt, ferry FROM links")
def network_tables(spark, sf):
    path = scratch(spark, "network")
    l = links(spark, sf)
    SF.write_network(l.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), l, path)
    nodes, back = SF.read_network(spark, path)
    return back.join(nodes.select(F.col("node_id").alias("u")), "u", "left_semi").select("u", "v", "tt", "ferry")


@query(
    "artifact_export",
    "SELECT l_returnflag AS zone_id, l_linestatus AS layer, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2",
)
def artifact_export(spark, sf):
    path = scratch(spark, "artifacts")
    SR.export_artifacts(
        I.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("zone_id"), F.col("l_linestatus").alias("layer"), "l_quantity"), path
    )
    back = spark.read.schema("l_quantity double, zone_id string, layer string").json(path)
    return back.groupBy("zone_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query("ingest_report", with_ctes("infra") + "SELECT infra_type, brand, count(*) AS n FROM infra GROUP BY GROUPING SETS ((infra_type, brand), (infra_type), ())")
def ingest_report(spark, sf):
    return SF.ingest_report(infra(spark, sf), "brand")


@query("parsed_attributes", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN event_type <> 'view' THEN event_type END AS name FROM events")
def parsed_attributes(spark, sf):
    e = I.table(spark, sf, "events").select(
        "event_id", F.col("props").alias("attributes"), F.lit("road").alias("infra_type"),
        F.when(F.col("event_type") == "view", F.lit(" nan ")).otherwise(F.col("event_type")).alias("name"),
    )
    return SF.parsed_attributes(e).select("event_id", F.col("attrs")["k"].cast("long").alias("k"), "name")


@query(
    "bulletin_manifest",
    """SELECT c.conv_id AS id, c.n AS turns, u.first_user, c.conv_id % 2 = 0 AS listed FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c
       LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS first_user FROM conversations WHERE role = 'user' GROUP BY 1) u ON u.conv_id = c.conv_id""",
)
def bulletin_manifest(spark, sf):
    c = I.table(spark, sf, "conversations")
    path = scratch(spark, "bulletins")
    c.groupBy(F.col("conv_id").alias("id")).agg(
        F.count(F.lit(1)).alias("turns"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("t")
    ).select("id", F.struct("turns", F.struct(F.col("t").alias("value"), F.lit(1).alias("page")).alias("first")).alias("body")).write.json(path)
    manifest = c.select(F.col("conv_id").alias("id")).distinct().filter("id % 2 = 0").withColumn("listed", F.lit(True))
    b = SR.bulletins(spark, path, "id bigint, body struct<turns: bigint, first: struct<value: string, page: int>>", manifest)
    return b.select("id", "body.turns", F.col("body.first.value").alias("first_user"), F.coalesce("listed", F.lit(False)).alias("listed"))


_GLAT = r_sql(f"({r_sql('21.5e0 + r * 0.24e0', 5)} + {r_sql(r_sql('21.5e0 + r * 0.24e0', 5) + ' + 0.24e0', 5)}) / 2e0", 5)


@query(
    "regular_grid",
    f"""WITH g AS (SELECT p_partkey, p_size, p_partkey // (((SELECT count(*) FROM part) + 4) // 5) AS r FROM part)
        SELECT p_partkey AS k, r, {_GLAT} AS lat, CASE WHEN p_size > 20 THEN p_size::DOUBLE END AS measured FROM g""",
)
def regular_grid(spark, sf):
    """A grid of five rows with a cell per part, heights from the table where it has them."""
    parts = I.table(spark, sf, "part").select("p_partkey", "p_size")
    n = parts.count()
    cols = -(-n // 5)  # the last row may be short
    k = F.col("p_partkey")
    cell = F.format_string("c%02d%02d", F.floor(k / cols).cast("int"), (k % cols).cast("int"))
    heights = parts.filter("p_size > 20").select(cell.alias("cell_id"), F.col("p_size").cast("double").alias("elevation"))
    grid = OH.regular_grid(spark, 5, cols, 88.0, 21.5, 89.1, 22.7, heights)
    known = heights.select("cell_id", F.lit(True).alias("known"))
    return grid.filter(F.col("r") * cols + F.col("c") < n).join(known, "cell_id", "left").select(
        (F.col("r") * cols + F.col("c")).cast("long").alias("k"), F.col("r").cast("long").alias("r"), "lat",
        F.when(F.col("known"), F.col("elevation")).alias("measured"),
    )


# --- Health facilities and clips -----------------------------------------------------------------


@query(
    "node_copies",
    with_ctes("sites", "boxes")
    + """SELECT s.pid, min(b.zone_id) AS area_id FROM sites s LEFT JOIN boxes b ON s.x > x0 AND s.x < x1 AND s.y > y0 AND s.y < y1 GROUP BY 1""",
)
def node_copies(spark, sf):
    """Nodes inside a facility polygon go into it (area_id); the others stay."""
    nodes = sites(spark, sf).withColumn("level", F.col("p_size") % 2).drop("p_size")
    kept, merged = SF.drop_node_copies(nodes, boxes(spark, sf), 2000.0)
    return merged.select("pid", "area_id").unionByName(kept.select("pid", F.lit(None).cast("int").alias("area_id")))


@query("clipped_points", with_ctes("sites", "boxes") + "SELECT pid FROM sites WHERE EXISTS (SELECT 1 FROM boxes WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)")
def clipped_points(spark, sf):
    return SF.clip_points(sites(spark, sf), boxes(spark, sf), 2000.0).select("pid")


@query(
    "ferry_connectors",
    with_ctes("sites", "towers")
    + """, n AS (SELECT pid, arg_min(tid, (d2, tid)) AS tid, sqrt(min(d2)) AS d FROM (SELECT pid, tid, ((x - tx) * (x - tx) + (y - ty) * (y - ty))::DOUBLE AS d2 FROM sites, towers) GROUP BY 1)
        SELECT pid AS u, 1000000 + tid AS v, floor(d * 1e6 + 0.5e0) / 1e6 AS length FROM n WHERE d <= 500 UNION ALL SELECT 1000000 + tid, pid, floor(d * 1e6 + 0.5e0) / 1e6 FROM n WHERE d <= 500""",
)
def ferry_connectors(spark, sf):
    from stormledger.plans.spatial_queries import towers

    near = S.nearest(sites(spark, sf).drop("p_size"), towers(spark, sf), 500.0, max_m=500.0)
    ends = near.select(
        F.col("pid").alias("node"), F.lit(0).alias("way_id"), (F.col("tid") + 1_000_000).alias("near_node"), "distance_m"
    )
    return N.connectors(ends).select("u", "v", round_to(F.col("length"), 6).alias("length"))


@query(
    "block_order",
    """WITH RECURSIVE s AS (SELECT l_returnflag AS road, l_orderkey AS seq_no, l_linenumber * 1000000 + l_suppkey AS i, 'block ' || (l_suppkey % 12) AS block FROM lineitem),
       f AS (SELECT road, block, min((seq_no, i)) AS seen FROM s GROUP BY 1, 2),
       b AS (SELECT road, list(block ORDER BY seen) AS blocks FROM f GROUP BY 1),
       n AS (SELECT road, block, lead(block) OVER (PARTITION BY road, seq_no ORDER BY i) AS after FROM s),
       e AS (SELECT road, list(DISTINCT {'a': block, 'z': after}) AS edges FROM n WHERE after <> block GROUP BY 1),
       o(road, blocks, edges, placed) AS (
         SELECT b.road, blocks, coalesce(edges, []), []::VARCHAR[] FROM b LEFT JOIN e ON e.road = b.road
         UNION ALL SELECT road, blocks, edges, list_append(placed, coalesce(
             list_filter(rest, lambda x: NOT list_contains(list_transform(list_filter(edges, lambda y: list_contains(rest, y.a)), lambda y: y.z), x))[1], rest[1]))
         FROM (SELECT *, list_filter(blocks, lambda x: NOT list_contains(placed, x)) AS rest FROM o WHERE len(placed) < len(blocks)))
       SELECT road, unnest(range(len(blocks))) AS pos, unnest(placed) AS block FROM o WHERE len(placed) = len(blocks)""",
)
def block_order(spark, sf):
    """Zones of each region in travel order, from the orders' partial sequences."""
    li = I.table(spark, sf, "lineitem")
    seq = li.select(
        F.col("l_returnflag").alias("road"), F.col("l_orderkey").alias("seq_no"),
        (F.col("l_linenumber") * F.lit(1_000_000).cast("long") + F.col("l_suppkey")).alias("i"),
        F.concat(F.lit("block "), (F.col("l_suppkey") % 12).cast("string")).alias("block"),
    )
    return M.block_order(seq)


@query(
    "grouped_links",
    """WITH l AS (SELECT p_partkey AS link, CASE WHEN p_size % 3 > 0 THEN p_name || ';x' END AS name, CASE WHEN p_type = 'LARGE' THEN 'ferry' ELSE 'road' END AS t, p_brand AS b FROM part),
       k AS (SELECT *, trim(string_split(name, ';')[1]) AS shown FROM l),
       e AS (SELECT *, CASE WHEN t = 'road' AND shown IS NOT NULL THEN 'road:' || shown WHEN shown IS NULL THEN 'unnamed|' || t || '|' || b || '|' || b || '|0' ELSE 'link:' || link END AS entry,
         coalesce(shown, CASE t WHEN 'ferry' THEN 'Unnamed ferry route' ELSE 'Unnamed road' END) AS label FROM k)
       SELECT entry, min(label) AS label, min(t) AS link_type, count(DISTINCT link) AS segments, count(DISTINCT l_suppkey) AS facility_count, min(l_suppkey % 20) AS earliest_deadline
       FROM e JOIN lineitem ON l_partkey = link GROUP BY 1""",
)
def grouped_links(spark, sf):
    return M.grouped_links(*link_users(spark, sf))


def link_users(spark, sf):
    """(links, facilities) of parts and the suppliers that deliver them."""
    p = I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("link"), F.when(F.col("p_size") % 3 > 0, F.concat("p_name", F.lit(";x"))).alias("name"),
        F.when(F.col("p_type") == "LARGE", F.lit("ferry")).otherwise(F.lit("road")).alias("link_type"),
        F.col("p_brand").alias("first_block"), F.col("p_brand").alias("last_block"), F.lit(0).alias("f1"),
    )
    f = I.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("link"), F.col("l_suppkey").alias("item"), (F.col("l_suppkey") % 20).alias("deadline")
    )
    return p.join(f.select("link"), "link", "left_semi"), f


@query(
    "split_features",
    with_ctes("tagged")
    + """SELECT id, highway IN ('trunk', 'primary') AS overview, amenity IN ('hospital', 'clinic') AND amenity = 'hospital' OR (amenity = 'clinic' AND regexp_matches(lower(name), 'rural hospital')) AS hospital FROM tagged""",
)
def split_features(spark, sf):
    t = F.col("tags")
    return tagged(spark, sf).select(
        "id", t["highway"].isin("trunk", "primary").alias("overview"), (F.coalesce(L.facility_level(t), F.lit("")) == "hospital").alias("hospital")
    )


@query(
    "rounded_lines",
    "SELECT p_partkey AS id, CASE WHEN p_size >= 10 THEN 3 ELSE 2 END AS vertices FROM part",
)
def rounded_lines(spark, sf):
    """Vertices rounded to 2 digits; repeats go, a line that would collapse keeps its two ends."""
    s = F.col("p_size") / F.lit(1000.0)
    pt = lambda x: F.struct(x.alias("x"), F.lit(1.0).alias("y"))
    far = F.when(F.col("p_size") >= 10, F.lit(0.05)).otherwise(F.lit(0.001))
    line = F.array(pt(F.lit(0.0)), pt(F.lit(0.001)), pt(F.lit(0.0) + far), pt(far * 2 + s * 0))
    return I.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.size(L.round_line(line, 2)).alias("vertices"))


