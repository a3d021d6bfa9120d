"""Network queries over links derived from customer keys.

Node k = customer key + 1. Tree link (k, k div 2) unless k % 7 = 0; an extra link (k, k + 1) for
every fiftieth node; a second link beside the tree link for k % 6 = 1. Scenarios are the days of
the event stream; day s closes the links with (link_id * 31 + s) % 17 = 0.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from stormledger.functions.numeric import round_to
from stormledger.operators import impact as M
from stormledger.operators import network as N
from stormledger.operators.joins import measured_join
from stormledger.plans import inputs as I
from stormledger.plans.inputs import CTE, with_ctes
from stormledger.plans.registry import query

ANCHOR = 1

CTE["nodes"] = ("SELECT c_custkey + 1 AS k, max(c_custkey) OVER () + 1 AS n FROM customer", [])
CTE["links"] = (
    """SELECT k * 4 AS link_id, k // 2 AS u, k AS v, k // 4 AS way_id, k % 5 = 0 AS ferry, 1 + k % 13 AS tt
         FROM nodes WHERE k >= 2 AND k % 7 <> 0
       UNION ALL SELECT k * 4 + 1, k, k + 1, k // 4, k % 5 = 0, 1 + k % 13 FROM nodes WHERE k % 50 = 0 AND k < n
       UNION ALL SELECT k * 4 + 2, k // 2, k, 1000000 + k // 4, false, 3 + k % 13 FROM nodes WHERE k >= 2 AND k % 6 = 1 AND k % 7 <> 0""",
    ["nodes"],
)
CTE["adj"] = (
    "SELECT u AS n, v AS m, link_id, tt FROM links UNION ALL SELECT v, u, link_id, tt FROM links", ["links"],
)
CTE["days"] = ("SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS step FROM events", [])
CTE["cuts"] = (
    "SELECT step, link_id, CASE WHEN ferry THEN 'wind' ELSE 'surge' END AS cut_by FROM days, links WHERE (link_id * 31 + step) % 17 = 0",
    ["days", "links"],
)
CTE["facilities"] = (
    "SELECT s_suppkey AS item, s_suppkey * 15 + 1 + s_suppkey % 7 AS node, s_suppkey % 23 = 22 AS too_far, s_suppkey % 4 = 0 AS hospital FROM supplier",
    [],
)


def links(spark, sf):
    k = F.col("k")
    n = F.col("n")

    def link(when, link_id, u, v, way, ferry, tt):
        return F.when(
            when,
            F.struct(
                link_id.alias("link_id"), u.alias("u"), v.alias("v"), way.alias("way_id"),
                ferry.alias("ferry"), tt.alias("tt"),
            ),
        )

    half, way = F.floor(k / 2).cast("long"), F.floor(k / 4).cast("long")
    tree = (k >= 2) & (k % 7 != 0)
    c = I.table(spark, sf, "customer")
    top = c.agg((F.max("c_custkey") + 1).alias("n"), F.lit("net").alias("network_id"))
    rows = F.array(
        link(tree, k * 4, half, k, way, k % 5 == 0, 1 + k % 13),
        link((k % 50 == 0) & (k < n), k * 4 + 1, k, k + 1, way, k % 5 == 0, 1 + k % 13),
        link(tree & (k % 6 == 1), k * 4 + 2, half, k, way + 1_000_000, F.lit(False), 3 + k % 13),
    )
    return (
        c.select((F.col("c_custkey") + 1).alias("k"), F.lit("net").alias("network_id"))
        .join(top, "network_id")
        .select("network_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x"))
        .select("network_id", "x.*")
        .withColumn("connector", F.lit(False))
    )


def days(spark, sf):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return I.table(spark, sf, "events").select(F.lit("net").alias("network_id"), day.alias("step")).distinct()


def cuts(spark, sf):
    """Days x links that the day closes: an equi-join on the network."""
    return cuts_of(links(spark, sf), days(spark, sf))


def cuts_of(links, days):
    return (
        measured_join(links, days, ["network_id"], "link_id")
        .filter((F.col("link_id") * 31 + F.col("step")) % 17 == 0)
        .select("step", "link_id", F.when(F.col("ferry"), F.lit("wind")).otherwise(F.lit("surge")).alias("cut_by"))
    )


def facilities(spark, sf):
    k = F.col("s_suppkey")
    return I.table(spark, sf, "supplier").select(
        k.alias("item"), (k * 15 + 1 + k % 7).alias("node"), (k % 23 == 22).alias("too_far"),
        (k % 4 == 0).alias("hospital"), F.lit("net").alias("network_id"),
    )


# --- Components and reachability -----------------------------------------------------------------

CTE["flood_labels"] = (
    """SELECT n AS node, n AS lab FROM adj UNION
       SELECT a.m, min(l.lab) FROM flood_labels l JOIN adj a ON a.n = l.node
         LEFT JOIN recurring.flood_labels r ON r.node = a.m WHERE r.lab IS NULL OR l.lab < r.lab GROUP BY a.m""",
    ["adj"],
)


def recursive(*names: str, using_key: dict[str, str]) -> str:
    """with_ctes with the recursive tables keyed: {"table": "(columns) USING KEY (key)"}."""
    text = with_ctes(*names, recursive=True)
    for name, decl in using_key.items():
        text = text.replace(f"{name} AS (", f"{name}{decl} AS (", 1) if text.startswith(f"WITH RECURSIVE {name} AS") else text.replace(f", {name} AS (", f", {name}{decl} AS (", 1)
    return text


_LABELS = {"flood_labels": "(node, lab) USING KEY (node)"}


@query(
    "components",
    recursive("flood_labels", using_key=_LABELS)
    + """, s AS (SELECT lab, count(*) AS size FROM flood_labels GROUP BY 1),
        o AS (SELECT lab, size, row_number() OVER (ORDER BY size DESC, lab) - 1 AS component FROM s)
        SELECT f.node, f.lab AS comp, o.size, o.component FROM flood_labels f JOIN o ON o.lab = f.lab""",
)
def components(spark, sf):
    c = N.components(links(spark, sf))
    return c.join(N.component_sizes(c), "comp").select("node", "comp", "size", "component")


@query(
    "component_sizes_without_ferries",
    recursive("flood_labels", using_key=_LABELS).replace("FROM links", "FROM links WHERE NOT ferry")
    + ", s AS (SELECT lab AS comp, count(*) AS size FROM flood_labels GROUP BY 1) SELECT comp, size, row_number() OVER (ORDER BY size DESC, comp) - 1 AS component FROM s",
)
def component_sizes_without_ferries(spark, sf):
    return N.component_sizes(N.components(links(spark, sf).filter("NOT ferry")))


@query(
    "way_components",
    recursive("flood_labels", using_key=_LABELS)
    + """, s AS (SELECT lab, count(*) AS size FROM flood_labels GROUP BY 1),
        o AS (SELECT lab, row_number() OVER (ORDER BY size DESC, lab) - 1 AS component FROM s),
        w AS (SELECT l.way_id, min(o.component) AS component FROM links l JOIN flood_labels f ON f.node = l.u JOIN o ON o.lab = f.lab GROUP BY 1)
        SELECT p_partkey AS way_id, w.component, coalesce(w.component = 0, false) AS reachable_from_main FROM part LEFT JOIN w ON w.way_id = p_partkey""",
)
def way_components(spark, sf):
    l = links(spark, sf)
    c = N.components(l)
    w = N.way_components(l, c, N.component_sizes(c))
    roads = I.table(spark, sf, "part").select(F.col("p_partkey").alias("way_id"))
    return roads.join(w, "way_id", "left").withColumn(
        "reachable_from_main", F.coalesce(F.col("component") == 0, F.lit(False))
    )


CTE["reach"] = (
    """SELECT step, 1::BIGINT AS node FROM days UNION
       SELECT r.step, a.m FROM reach r JOIN adj a ON a.n = r.node
       WHERE (a.link_id * 31 + r.step) % 17 <> 0""",
    ["days", "adj"],
)


def reach(spark, sf):
    return N.reachable(links(spark, sf), cuts(spark, sf).drop("cut_by"), days(spark, sf), ANCHOR, ["step"])


@query("reachable_by_step", with_ctes("reach", recursive=True) + "SELECT step, node FROM reach")
def reachable_by_step(spark, sf):
    return reach(spark, sf)


@query(
    "island_links",
    """WITH RECURSIVE """ + with_ctes("facilities", "adj").removeprefix("WITH ")
    + """, j(node) AS (SELECT 1::BIGINT UNION SELECT a.m FROM j JOIN adj a ON a.n = j.node),
        b(node) AS (SELECT 1::BIGINT UNION SELECT a.m FROM b JOIN adj a ON a.n = b.node JOIN links l ON l.link_id = a.link_id AND NOT l.ferry)
        SELECT item AS place, f.node, j.node IS NOT NULL AS joined, j.node IS NOT NULL AND b.node IS NULL AS via_ferry
        FROM facilities f LEFT JOIN j ON j.node = f.node LEFT JOIN b ON b.node = f.node""",
)
def island_links(spark, sf):
    places = facilities(spark, sf).select(F.col("item").alias("place"), "node")
    return N.island_links(links(spark, sf), places, ANCHOR)


# --- Shortest paths ------------------------------------------------------------------------------

CTE["base"] = (
    """SELECT 1::BIGINT AS node, 0::BIGINT AS dist UNION
       SELECT a.m, min(s.dist + a.tt) FROM base s JOIN adj a ON a.n = s.node LEFT JOIN recurring.base r ON r.node = a.m
       WHERE r.dist IS NULL OR s.dist + a.tt < r.dist GROUP BY a.m""",
    ["adj"],
)
CTE["base_tree"] = (
    """SELECT b.node, any_value(b.dist) AS dist, min(a.m) AS via FROM base b
       LEFT JOIN (SELECT a.n, a.m, b2.dist + a.tt AS d FROM adj a JOIN base b2 ON b2.node = a.m) a ON a.n = b.node AND a.d = b.dist AND b.node <> 1
       GROUP BY b.node""",
    ["base"],
)
CTE["usual"] = (
    """SELECT item, node, 0::BIGINT AS pos FROM facilities UNION ALL
       SELECT u.item, t.via, u.pos + 1 FROM usual u JOIN base_tree t ON t.node = u.node WHERE t.via IS NOT NULL""",
    ["facilities", "base_tree"],
)
CTE["first_cuts"] = (
    """SELECT step, item, min(pos) AS pos, arg_min(fast, pos) AS link_id FROM (
         SELECT c.step, h.item, h.pos, p.fast FROM (
             SELECT u.item, u.pos, least(u.node, w.node) AS a, greatest(u.node, w.node) AS b
             FROM usual u JOIN usual w ON w.item = u.item AND w.pos = u.pos + 1) h
         JOIN (SELECT u, v, count(*) AS parallel, arg_min(link_id, tt * 100000000 + link_id) AS fast FROM links GROUP BY 1, 2) p
           ON p.u = h.a AND p.v = h.b
         JOIN (SELECT c.step, l.u, l.v, count(*) AS n FROM cuts c JOIN links l ON l.link_id = c.link_id GROUP BY 1, 2, 3) c
           ON c.u = h.a AND c.v = h.b AND c.n = p.parallel) GROUP BY 1, 2""",
    ["usual", "cuts"],
)
CTE["isolated"] = (
    """SELECT f.step, f.item, a.node, c.cut_by AS hazard, f.link_id, l.way_id, l.ferry FROM first_cuts f
       JOIN facilities a ON a.item = f.item AND NOT a.too_far
       JOIN cuts c ON c.step = f.step AND c.link_id = f.link_id JOIN links l ON l.link_id = f.link_id
       WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.step = f.step AND r.node = a.node)""",
    ["first_cuts", "reach"],
)
_BASE = {"base": "(node, dist) USING KEY (node)"}


def base_tree(spark, sf):
    anchor = spark.createDataFrame([(0, ANCHOR)], "source long, node long")
    return N.nearest_source(links(spark, sf), anchor)


def usual_hops(spark, sf):
    return N.paths(base_tree(spark, sf), facilities(spark, sf).select("item", "node"))


def isolated(spark, sf):
    return Net(spark, sf).isolated()


class Net:
    """One query's network: the tables that several of its operators read, each stored once.

    What the anchor does not reach without cuts is never cut off from it, nor a refuge, so links
    and cuts are those of its component.
    """

    def __init__(self, spark, sf):
        self.spark, self.sf, self.work = spark, sf, N.WorkTables(spark, "net")
        self.facilities = facilities(spark, sf)

    @cached_property
    def links(self):
        whole = N.WorkTables(self.spark, "whole-net").save(links(self.spark, self.sf))
        return self.work.save(N.joined_links(whole, N.joined_nodes(whole, ANCHOR)))

    @cached_property
    def days(self):
        return self.work.save(days(self.spark, self.sf))

    @cached_property
    def cuts(self):
        return self.work.save(cuts_of(self.links, self.days))

    @cached_property
    def tree(self):
        return N.nearest_source(self.links, self.spark.createDataFrame([(0, ANCHOR)], "source long, node long"))

    def isolated(self):
        hops = N.paths(self.tree, self.facilities.select("item", "node"))
        return M.isolation_by_repair(self.facilities, self.links, self.cuts, self.tree, hops, ["step"])

    def departures(self):
        ever = self.work.save(self.isolated().select("item").distinct())
        leaving = self.facilities.join(ever, "item", "left_semi")
        # A place the anchor's network never reached is never cut off from it, but it is no refuge either.
        safe = self.facilities.filter("hospital AND NOT too_far").join(ever, "item", "left_anti").join(
            self.tree.select("node"), "node", "left_semi").select(F.col("item").alias("source"), "node", "network_id")
        return M.departures(leaving, self.links, self.cuts, safe, self.days)

    def critical(self):
        """(routes by way, departures, start of the axis)."""
        found, hops = self.departures()
        route = self.work.save(M.routes(hops, self.links))
        departs = self.work.save(found.select("item", "deadline", "stays_open", F.lit("net").alias("network_id")))
        return route, departs, self.days.groupBy("network_id").agg(F.min("step").alias("start"))


@query("baseline_times", recursive("base_tree", using_key=_BASE) + "SELECT node, dist::DOUBLE AS dist, via AS via_node FROM base_tree")
def baseline_times(spark, sf):
    return base_tree(spark, sf).select("node", "dist", "via_node")


@query("first_cut", recursive("first_cuts", using_key=_BASE) + "SELECT step, item, pos::INTEGER AS pos, link_id FROM first_cuts")
def first_cut(spark, sf):
    return N.first_cut(usual_hops(spark, sf), links(spark, sf), cuts(spark, sf), ["step"])


_CAUSE = "CASE WHEN ferry THEN 'ferry suspended by wind' ELSE 'road flooded by storm surge' END"


@query(
    "isolated_by_step",
    recursive("isolated", using_key=_BASE) + f"SELECT step, item, hazard, link_id, way_id, {_CAUSE} AS cause FROM isolated",
)
def isolated_by_step(spark, sf):
    return isolated(spark, sf).select(
        "step", "item", "hazard", "link_id", "way_id", M.cause_text(F.col("ferry"), F.col("hazard")).alias("cause")
    )


@query(
    "isolation_pathway",
    recursive("isolated", using_key=_BASE)
    + """SELECT step, item, 'hazard:' || hazard || ' > ' || CASE WHEN way_id % 3 = 0 THEN 'road-' || way_id ELSE 'road-way-' || way_id END || ' > ' || item AS ids,
        'First cut on its usual route: ' || CASE WHEN way_id % 3 <> 0 THEN 'unmapped road segment (way ' || way_id || ')'
          WHEN way_id % 2 = 0 THEN 'Road ' || way_id WHEN ferry THEN 'Unnamed ferry route' ELSE 'Unnamed road' END AS cut_label FROM isolated""",
)
def isolation_pathway(spark, sf):
    return isolation_pathways(spark, sf).select(
        "step", "item", F.array_join(F.transform("pathway", lambda x: x["id"]), " > ").alias("ids"),
        F.element_at("pathway", 2)["label"].alias("cut_label"),
    )


def isolation_pathways(spark, sf):
    way = F.col("way_id")
    roads = links(spark, sf).select("way_id").distinct().filter(way % 3 == 0).select(
        "way_id", F.concat(F.lit("road-"), way.cast("string")).alias("road_id"),
        F.when(way % 2 == 0, F.concat(F.lit("Road "), way.cast("string"))).alias("road_name"),
    )
    iso = isolated(spark, sf).withColumn("value", F.lit(0.3)).withColumn("label", F.col("item").cast("string"))
    return M.pathway(iso, roads)


CTE["two"] = (
    """SELECT node, source, 0::BIGINT AS dist FROM (SELECT item AS source, node FROM facilities WHERE hospital) UNION
       SELECT a.m, s.source, min(s.dist + a.tt) FROM two s JOIN adj a ON a.n = s.node LEFT JOIN recurring.two r ON r.node = a.m AND r.source = s.source
       WHERE r.dist IS NULL OR s.dist + a.tt < r.dist GROUP BY a.m, s.source""",
    ["facilities", "adj"],
)
_TWO = {"two": "(node, source, dist) USING KEY (node, source)"}


def hospitals(spark, sf):
    return facilities(spark, sf).filter("hospital").select(F.col("item").alias("source"), "node", "network_id")


@query(
    "k_nearest",
    recursive("two", using_key=_TWO)
    + """SELECT * FROM (SELECT node, source, dist::DOUBLE AS dist, row_number() OVER (PARTITION BY node ORDER BY dist, source)::INTEGER AS rank FROM two) WHERE rank <= 2""",
)
def k_nearest(spark, sf):
    return N.k_nearest_sources(links(spark, sf), hospitals(spark, sf).drop("network_id"), 2).select("node", "source", "dist", "rank")


@query(
    "facility_access",
    "WITH RECURSIVE " + recursive("two", using_key=_TWO).removeprefix("WITH RECURSIVE ")
    + ", " + "base(node, dist) USING KEY (node) AS (" + CTE["base"][0] + ")"
    + """, k AS (SELECT node, source, dist, row_number() OVER (PARTITION BY node ORDER BY dist, source) AS rank FROM two)
        SELECT f.item, f.node, f.too_far, CASE WHEN NOT too_far THEN b.dist END AS baseline_travel_time_s,
          CASE WHEN NOT too_far THEN (SELECT min(dist) FROM k WHERE k.node = f.node AND k.rank <= 2 AND NOT (f.hospital AND k.source = f.item)) END AS hospital_travel_time_s
        FROM facilities f LEFT JOIN base b ON b.node = f.node""",
)
def facility_access(spark, sf):
    f = facilities(spark, sf)
    l = links(spark, sf)
    two = N.k_nearest_sources(l, hospitals(spark, sf).drop("network_id"), 2)
    return N.baseline_access(
        f.select("item", "node", "too_far"), base_tree(spark, sf), two, f.filter("hospital").select("item")
    )


# --- Departures and critical links ---------------------------------------------------------------

# Distance and source as one number, so that the keyed recursion has a single minimum.
CTE["ever"] = ("SELECT DISTINCT item FROM isolated", ["isolated"])
CTE["safe"] = ("SELECT f.item AS source, f.node FROM facilities f WHERE hospital AND NOT too_far AND f.node IN (SELECT node FROM base) AND NOT EXISTS (SELECT 1 FROM ever e WHERE e.item = f.item)", ["ever", "base"])
CTE["near"] = (
    """SELECT step, node, min(source) AS best FROM safe, days GROUP BY 1, 2 UNION
       SELECT s.step, a.m, min(s.best + a.tt * 1000000) FROM near s JOIN adj a ON a.n = s.node
       LEFT JOIN recurring.near r ON r.step = s.step AND r.node = a.m
       WHERE (a.link_id * 31 + s.step) % 17 <> 0 AND (r.best IS NULL OR s.best + a.tt * 1000000 < r.best) GROUP BY s.step, a.m""",
    ["safe", "days", "adj"],
)
CTE["departing"] = (
    """SELECT f.item, f.node, min(d.step) AS lo, max(d.step) AS hi, min(d.step) FILTER (n.best IS NULL) AS closed
       FROM facilities f CROSS JOIN days d LEFT JOIN near n ON n.step = d.step AND n.node = f.node
       WHERE NOT too_far AND f.item IN (SELECT item FROM ever) GROUP BY 1, 2""",
    ["near"],
)
CTE["departs"] = (
    """SELECT f.item, d.node, CASE WHEN closed IS NULL THEN hi WHEN closed > lo THEN (SELECT max(step) FROM days WHERE step < closed) END AS deadline,
         coalesce(closed IS NULL AND d.item IS NOT NULL, false) AS stays_open
       FROM facilities f LEFT JOIN departing d ON d.item = f.item WHERE f.item IN (SELECT item FROM ever)""",
    ["departing"],
)
_NEAR = {"base": "(node, dist) USING KEY (node)", "near": "(step, node, best) USING KEY (step, node)"}


@query(
    "last_departure",
    recursive("departs", using_key=_NEAR)
    + """SELECT d.item, d.deadline, d.stays_open, n.best % 1000000 AS source, n.best // 1000000 AS travel_time_s,
        CASE WHEN d.deadline IS NULL THEN 'No safe destination reachable by road at any step' END AS note
        FROM departs d LEFT JOIN near n ON n.step = d.deadline AND n.node = d.node""",
)
def last_departure(spark, sf):
    d, _ = Net(spark, sf).departures()
    return d.select("item", "deadline", "stays_open", "source", "travel_time_s", "note")


CTE["near_tree"] = (
    """SELECT b.step, b.node, min(a.m) AS via FROM near b
       JOIN adj a ON a.n = b.node AND (a.link_id * 31 + b.step) % 17 <> 0
       JOIN near b2 ON b2.step = b.step AND b2.node = a.m AND b2.best + a.tt * 1000000 = b.best GROUP BY 1, 2""",
    ["near", "adj"],
)
CTE["way_hops"] = (
    """SELECT item, deadline AS step, node, 0::BIGINT AS pos FROM departs WHERE deadline IS NOT NULL UNION ALL
       SELECT w.item, w.step, t.via, w.pos + 1 FROM way_hops w JOIN near_tree t ON t.step = w.step AND t.node = w.node""",
    ["departs", "near_tree"],
)
CTE["route_ways"] = (
    """SELECT item, way_id, min(pos) AS ord FROM (
         SELECT h.item, h.pos, arg_min(l.way_id, l.link_id) AS way_id FROM way_hops h JOIN way_hops g ON g.item = h.item AND g.pos = h.pos + 1
         JOIN near b ON b.step = h.step AND b.node = h.node JOIN near b2 ON b2.step = h.step AND b2.node = g.node
         JOIN links l ON l.u = least(h.node, g.node) AND l.v = greatest(h.node, g.node)
           AND (l.link_id * 31 + h.step) % 17 <> 0 AND b2.best + l.tt * 1000000 = b.best GROUP BY 1, 2) GROUP BY 1, 2""",
    ["way_hops"],
)
CTE["elig"] = (
    """SELECT item, deadline, 0 AS horizon_h, unnest(generate_series((SELECT min(step) FROM days), deadline)) AS step FROM departs WHERE deadline IS NOT NULL
       UNION ALL SELECT item, deadline, 24, unnest(generate_series(greatest((SELECT min(step) FROM days), deadline - 8), deadline)) FROM departs WHERE deadline IS NOT NULL AND NOT stays_open""",
    ["departs"],
)


@query(
    "critical_ways",
    recursive("elig", "route_ways", using_key=_NEAR)
    + """SELECT e.step, e.horizon_h, r.way_id, count(*) AS facilities, min(e.deadline) AS earliest FROM elig e JOIN route_ways r ON r.item = e.item GROUP BY 1, 2, 3""",
)
def critical_ways(spark, sf):
    users = M.by_step(M.use_intervals(*Net(spark, sf).critical(), ["way_id"]))
    return users.select("step", "horizon_h", "way_id", "facilities", "earliest")


def ways(spark, sf):
    w = F.col("way_id")
    return links(spark, sf).groupBy("way_id").agg(F.bool_or("ferry").alias("ferry")).select(
        "way_id", F.when(w % 4 != 0, F.concat(F.lit("Road "), (w % 5).cast("string"))).alias("name"),
        F.when(F.col("ferry"), F.lit("ferry")).otherwise(F.lit("road")).alias("link_type"),
    )


@query(
    "critical_links",
    recursive("elig", "route_ways", using_key=_NEAR)
    + """, w AS (SELECT way_id, CASE WHEN way_id % 4 <> 0 THEN 'Road ' || (way_id % 5) END AS name, CASE WHEN bool_or(ferry) THEN 'ferry' ELSE 'road' END AS link_type FROM links GROUP BY 1),
        users AS (SELECT e.step, e.horizon_h, r.way_id, count(*) AS n, min(e.deadline) AS earliest, string_agg(e.item::VARCHAR, ',' ORDER BY e.item) AS who
          FROM elig e JOIN route_ways r ON r.item = e.item GROUP BY 1, 2, 3),
        keyed AS (SELECT u.*, w.name, w.link_type, coalesce(w.name, '-') || w.link_type || who AS key FROM users u JOIN w ON w.way_id = u.way_id),
        nxt AS (SELECT item, way_id, lead(way_id) OVER (PARTITION BY item ORDER BY ord) AS next_way FROM route_ways),
        pair AS (SELECT DISTINCT e.step, e.horizon_h, a.way_id AS u, b.way_id AS v FROM elig e JOIN nxt ON nxt.item = e.item
          JOIN keyed a ON a.step = e.step AND a.horizon_h = e.horizon_h AND a.way_id = nxt.way_id
          JOIN keyed b ON b.step = e.step AND b.horizon_h = e.horizon_h AND b.way_id = nxt.next_way WHERE a.key = b.key),
        sym AS (SELECT step, horizon_h, u, v FROM pair UNION SELECT step, horizon_h, v, u FROM pair),
        grp(step, horizon_h, way_id, lab) USING KEY (step, horizon_h, way_id) AS (SELECT step, horizon_h, way_id, way_id FROM keyed UNION
          SELECT s.step, s.horizon_h, s.v, min(g.lab) FROM grp g JOIN sym s ON s.step = g.step AND s.horizon_h = g.horizon_h AND s.u = g.way_id
          JOIN recurring.grp r ON r.step = s.step AND r.horizon_h = s.horizon_h AND r.way_id = s.v WHERE g.lab < r.lab GROUP BY 1, 2, 3)
        SELECT k.step, k.horizon_h, g.lab AS link, min(k.name) AS name, min(k.link_type) AS link_type, max(k.n) AS facility_count,
          min(k.earliest) AS earliest_deadline, count(*) AS ways
        FROM keyed k JOIN grp g ON g.step = k.step AND g.horizon_h = k.horizon_h AND g.way_id = k.way_id GROUP BY 1, 2, 3""",
)
def critical_links(spark, sf):
    return M.critical_links(*Net(spark, sf).critical(), ways(spark, sf))


@query(
    "countdown",
    recursive("isolated", using_key=_BASE)
    + """, a AS (SELECT DISTINCT i.item, d.step FROM isolated i JOIN days d ON d.step BETWEEN i.step - 3 AND i.step)
        SELECT item, step, ((SELECT min(i.step) FROM isolated i WHERE i.item = a.item AND i.step > a.step) - step) * 24 AS hours_remaining
        FROM a WHERE NOT EXISTS (SELECT 1 FROM isolated i WHERE i.item = a.item AND i.step = a.step)""",
)
def countdown(spark, sf):
    iso = N.WorkTables(spark, "isolated").save(isolated(spark, sf).select("item", "step"))
    ahead = iso.select("item", F.explode(F.sequence(F.greatest(F.lit(0), F.col("step") - 3), "step")).alias("step")).distinct()
    return M.countdown(ahead, iso, 24)


@query(
    "route_legs",
    recursive("usual", using_key=_BASE)
    + """, h AS (SELECT u.item, u.pos, u.node AS a, w.node AS b FROM usual u JOIN usual w ON w.item = u.item AND w.pos = u.pos + 1),
        l AS (SELECT h.*, x.ferry, x.tt FROM h JOIN (SELECT u, v, arg_min(ferry, tt * 100000000 + link_id) AS ferry, min(tt) AS tt FROM links GROUP BY 1, 2) x ON x.u = least(a, b) AND x.v = greatest(a, b)),
        t AS (SELECT *, CASE WHEN lag(ferry) OVER (PARTITION BY item ORDER BY pos) <> ferry THEN 1 ELSE 0 END AS turn FROM l),
        g AS (SELECT *, sum(turn) OVER (PARTITION BY item ORDER BY pos)::BIGINT AS leg FROM t)
        SELECT item, leg, ferry, arg_min(a, pos) AS from_node, arg_max(b, pos) AS to_node, sum(tt)::BIGINT AS seconds, count(*) AS hops FROM g GROUP BY 1, 2, 3""",
)
def route_legs(spark, sf):
    return N.legs(usual_hops(spark, sf), links(spark, sf), ["item"])


# --- Building links ------------------------------------------------------------------------------


@query(
    "collapse_links",
    """WITH e AS (SELECT l_orderkey % 400 AS u, l_partkey % 300 AS v, l_suppkey % 7 AS way_id, l_quantity AS length, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS edge_id FROM lineitem)
       SELECT least(u, v) AS u, greatest(u, v) AS v, way_id, min(edge_id) AS link_id, arg_min(length, edge_id) AS length FROM e
       GROUP BY least(u, v), greatest(u, v), way_id, length""",
)
def collapse_links(spark, sf):
    e = I.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 400).alias("u"), (F.col("l_partkey") % 300).alias("v"),
        (F.col("l_suppkey") % 7).alias("way_id"), F.col("l_quantity").alias("length"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("edge_id"),
    )
    return N.collapse(e).select("u", "v", "way_id", "link_id", "length")


@query(
    "fastest_links",
    with_ctes("links") + "SELECT u, v, arg_min(link_id, tt * 100000000 + link_id) AS link_id, min(tt) AS tt, count(*) AS parallel FROM links GROUP BY 1, 2",
)
def fastest_links(spark, sf):
    return N.fastest(links(spark, sf))


@query(
    "ferry_ends",
    with_ctes("links")
    + """, e AS (SELECT way_id, u AS node, v AS near FROM links WHERE ferry UNION ALL SELECT way_id, v, u FROM links WHERE ferry),
        f AS (SELECT DISTINCT node FROM (SELECT way_id, node FROM e GROUP BY 1, 2 HAVING count(DISTINCT near) = 1))
        SELECT f.node, (SELECT bool_and(ferry) FROM links l WHERE l.u = f.node OR l.v = f.node) AS stranded FROM f""",
)
def ferry_ends(spark, sf):
    l = links(spark, sf)
    off = N.stranded_ferry_ends(l).withColumn("stranded", F.lit(True))
    return N.ferry_ends(l).select("node").distinct().join(off, "node", "left").withColumn(
        "stranded", F.coalesce("stranded", F.lit(False))
    )


_ROAD_KINDS = "['primary', 'secondary', 'tertiary', 'unclassified', 'trunk', 'track']"


@query(
    "link_travel_time",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, floor((l_extendedprice / (kph / 3.6e0) + CASE WHEN ferry THEN 900e0 ELSE 0e0 END) * 1e4 + 0.5e0) / 1e4 AS tt FROM (
        SELECT *, CASE WHEN ferry THEN 12e0 WHEN connector THEN 5e0 WHEN h = 'primary' THEN 50e0 WHEN h = 'secondary' THEN 40e0
          WHEN h = 'tertiary' THEN 30e0 WHEN h = 'trunk' THEN 60e0 ELSE 20e0 END AS kph FROM (
          SELECT *, ({_ROAD_KINDS})[l_partkey % 6 + 1] AS h, l_returnflag = 'R' AS ferry, l_returnflag = 'A' AS connector FROM lineitem))""",
)
def link_travel_time(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ["primary", "secondary", "tertiary", "unclassified", "trunk", "track"]])
    speeds = spark.createDataFrame(N.CLASS_KPH, "highway string, kph double")
    l = I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("length"),
        F.element_at(kinds, (F.col("l_partkey") % 6 + 1).cast("int")).alias("highway"),
        (F.col("l_returnflag") == "R").alias("ferry"), (F.col("l_returnflag") == "A").alias("connector"),
    )
    return N.travel_time(l, speeds).select("l_orderkey", "l_linenumber", "l_partkey", round_to(F.col("tt"), 4).alias("tt"))


@query("simplified_links")
def simplified_links(spark, sf):
    return N.simplify(links(spark, sf))
