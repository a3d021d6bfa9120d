"""Road and ferry networks: links, components, reachability, nearest sources, paths.

links: link_id, u, v, way_id, ferry, connector, tt (undirected; u <= v).
cuts:  scenario columns + link_id. A scenario is any set of columns, e.g. (event, step).

The loops are rounds of joins and partial aggregations over whole tables. Each round is written
and read back (see session.WorkTables); the driver only learns whether anything changed. Heavily
linked nodes reach a round as many rows with one key: their messages are combined map-side by
min, and the joins have one row per node on the other side, which adaptive execution splits.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormledger.functions.geo import haversine_km
from stormledger.functions.ranking import global_row_number, grouped_row_number
from stormledger.operators.joins import measured_join
from stormledger.session import WorkTables

HOPS_PER_ROUND = 4
STEPS_PER_ROUND = 3  # relaxations between two written states

# km/h by road class, and for the other kinds of link.
CLASS_KPH = [
    ("motorway", 80.0), ("motorway_link", 80.0), ("trunk", 60.0), ("trunk_link", 60.0),
    ("primary", 50.0), ("primary_link", 50.0), ("secondary", 40.0), ("secondary_link", 40.0),
    ("tertiary", 30.0), ("tertiary_link", 30.0), ("unclassified", 20.0),
]
FALLBACK_KPH, FERRY_KPH, CONNECTOR_KPH, BOARDING_S = 20.0, 12.0, 5.0, 900.0
MAX_FERRY_KM = 50.0


# --- Building links ------------------------------------------------------------------------------


def collapse(edges: DataFrame) -> DataFrame:
    """Directed edges to undirected links: one per (end pair, way, length to 0.1 m)."""
    first = [c for c in edges.columns if c not in ("u", "v", "way_id", "edge_id")]
    return (
        edges.withColumn("a", F.least("u", "v"))
        .withColumn("b", F.greatest("u", "v"))
        .groupBy("a", "b", "way_id", F.round("length", 1).alias("_len"))
        .agg(
            F.min("edge_id").alias("link_id"),
            F.min_by(F.struct(*first), "edge_id").alias("x"),
        )
        .select("link_id", F.col("a").alias("u"), F.col("b").alias("v"), "way_id", "x.*")
    )


def fastest(links: DataFrame) -> DataFrame:
    """The fastest link of each pair of nodes, and how many there are."""
    return links.groupBy("u", "v").agg(
        F.min_by("link_id", F.struct("tt", "link_id")).alias("link_id"),
        F.min("tt").alias("tt"),
        F.count(F.lit(1)).alias("parallel"),
    )


def travel_time(links: DataFrame, speeds: DataFrame) -> DataFrame:
    """Seconds per link from class speeds; ferries add boarding, connectors are walked."""
    kph = (
        F.when(F.col("ferry"), F.lit(FERRY_KPH))
        .when(F.col("connector"), F.lit(CONNECTOR_KPH))
        .otherwise(F.coalesce("kph", F.lit(FALLBACK_KPH)))
    )
    boarding = F.when(F.col("ferry"), F.lit(BOARDING_S)).otherwise(F.lit(0.0))
    return (
        links.join(speeds, "highway", "left")
        .withColumn("kph", kph)
        .withColumn("tt", F.col("length") / (F.col("kph") / F.lit(3.6)) + boarding)
    )


def line_km(coords: Column) -> Column:
    """Length of an array of struct(lat, lon)."""
    legs = F.transform(
        F.sequence(F.lit(1), F.size(coords) - 1),
        lambda i: haversine_km(
            F.element_at(coords, i)["lat"], F.element_at(coords, i)["lon"],
            F.element_at(coords, i + 1)["lat"], F.element_at(coords, i + 1)["lon"],
        ),
    )
    return F.when(F.size(coords) < 2, F.lit(0.0)).otherwise(
        F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x)
    )


def drop_long_ferries(ways: DataFrame, max_km: float = MAX_FERRY_KM) -> DataFrame:
    return ways.filter(~(F.col("ferry") & (line_km(F.col("geometry")) > max_km)))


def both_ways(links: DataFrame) -> DataFrame:
    """Each link from either end: n, m, link_id, tt."""
    ends = F.array(
        F.struct(F.col("u").alias("n"), F.col("v").alias("m")),
        F.struct(F.col("v").alias("n"), F.col("u").alias("m")),
    )
    return links.select("link_id", "tt", F.explode(ends).alias("e")).select(
        "e.n", "e.m", "link_id", "tt"
    )


def ferry_ends(links: DataFrame) -> DataFrame:
    """(way_id, node): nodes with a single neighbour inside a ferry way."""
    e = links.filter("ferry").select(
        "way_id",
        F.explode(
            F.array(
                F.struct(F.col("u").alias("node"), F.col("v").alias("near")),
                F.struct(F.col("v").alias("node"), F.col("u").alias("near")),
            )
        ).alias("x"),
    )
    # min = max instead of a distinct count: combines map-side whatever the degree.
    return (
        e.groupBy("way_id", "x.node")
        .agg(F.min("x.near").alias("lo"), F.max("x.near").alias("hi"))
        .filter("lo = hi")
        .select("way_id", "node")
    )


def stranded_ferry_ends(links: DataFrame) -> DataFrame:
    """Ferry way ends no road link touches."""
    at = links.select("ferry", F.explode(F.array("u", "v")).alias("node"))
    only_ferry = at.groupBy("node").agg(F.bool_and("ferry").alias("only")).filter("only").select("node")
    return ferry_ends(links).select("node").distinct().join(only_ferry, "node", "left_semi")


def connectors(ends: DataFrame, max_m: float = 500.0) -> DataFrame:
    """Both directed rows for each ferry end with a road node within reach.

    ends: node, way_id, near_node, distance_m (from spatial.nearest).
    """
    pair = F.array(
        F.struct(F.col("node").alias("u"), F.col("near_node").alias("v")),
        F.struct(F.col("near_node").alias("u"), F.col("node").alias("v")),
    )
    return (
        ends.filter(F.col("distance_m") <= max_m)
        .select("way_id", F.col("distance_m").alias("length"), F.explode(pair).alias("e"))
        .select("e.u", "e.v", "way_id", "length", F.lit(False).alias("ferry"), F.lit(True).alias("connector"))
    )


# --- Components ----------------------------------------------------------------------------------


def components(links: DataFrame, scenario: list[str] | None = None) -> DataFrame:
    """(scenario.., node, comp): comp is the lowest node of the component.

    Contraction: every node points at its lowest neighbour, chains are shortened by pointer
    jumping, pointed-together nodes become one, and only links between different ones remain.
    The link table shrinks by the round; the maps are composed at the end. The maps are as long as
    the node table, so they are merged with, never sent through the driver.
    """
    scn = scenario or []
    work = WorkTables(links.sparkSession, "components")
    live = F.lit(True).alias("live")
    edges, left = work.save_counting(
        links.select(*scn, F.col("u").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        .select(*scn, "a", "b", live),
        "live",
    )
    nodes = links.select(*scn, F.explode(F.array("u", "v")).alias("node")).distinct()
    maps: list[DataFrame] = []
    while left:
        ends = F.array(
            F.struct(F.col("a").alias("n"), F.col("b").alias("m")),
            F.struct(F.col("b").alias("n"), F.col("a").alias("m")),
        )
        points = (
            edges.select(*scn, F.explode(ends).alias("e"))
            .groupBy(*scn, F.col("e.n").alias("n"))
            .agg(F.min("e.m").alias("m"))
            .withColumn("to", F.least("n", "m"))
            .select(*scn, "n", "to")
        )
        points = _jump(work, work.save(points), scn)
        maps.append(points)
        a = points.select(*scn, F.col("n").alias("a"), F.col("to").alias("a2"))
        b = points.select(*scn, F.col("n").alias("b"), F.col("to").alias("b2"))
        edges, left = work.save_counting(
            edges.join(a.hint("merge"), [*scn, "a"]).join(b.hint("merge"), [*scn, "b"])
            .select(*scn, F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .filter("a <> b").distinct().select(*scn, "a", "b", live),
            "live",
        )
    composed = None
    for step in reversed(maps):
        if composed is None:
            composed = step
        else:
            later = composed.select(*scn, F.col("n").alias("to"), F.col("to").alias("root"))
            composed = step.join(later.hint("merge"), [*scn, "to"], "left").select(
                *scn, "n", F.coalesce("root", "to").alias("to")
            )
    if composed is None:
        return nodes.withColumn("comp", F.col("node"))
    label = composed.select(*scn, F.col("n").alias("node"), F.col("to").alias("root"))
    found = work.save(
        nodes.join(label.hint("merge"), [*scn, "node"], "left").select(
            *scn, "node", F.coalesce("root", "node").alias("comp")
        )
    )
    work.keep_last()
    return found


def _jump(work: WorkTables, points: DataFrame, scn: list[str]) -> DataFrame:
    """Follow pointers to their roots, doubling the reach per round."""
    while True:
        hop = points.select(*scn, F.col("n").alias("to"), F.col("to").alias("next"))
        points, moved = work.save_counting(
            points.drop("moved").join(hop.hint("merge"), [*scn, "to"], "left").select(
                *scn, "n", F.coalesce("next", "to").alias("to"),
                (F.coalesce("next", "to") != F.col("to")).alias("moved"),
            ),
            "moved",
        )
        if moved == 0:
            return points.drop("moved")


def component_sizes(comps: DataFrame, scenario: list[str] | None = None) -> DataFrame:
    """Components numbered from 0 by size, then lowest node."""
    scn = scenario or []
    sizes = comps.groupBy(*scn, "comp").agg(F.count(F.lit(1)).alias("size"))
    order = [F.desc("size"), F.col("comp")]
    numbered = grouped_row_number(sizes, scn, order, "no") if scn else global_row_number(sizes, order, "no")
    return numbered.withColumn("component", F.col("no") - 1).drop("no")


def way_components(links: DataFrame, comps: DataFrame, numbers: DataFrame) -> DataFrame:
    """The best-connected (lowest-numbered) component of each way's links."""
    c = comps.join(numbers.select("comp", "component"), "comp")
    return (
        links.select("way_id", F.col("u").alias("node"))
        .join(c.select("node", "component"), "node")
        .groupBy("way_id")
        .agg(F.min("component").alias("component"))
    )


def joined_nodes(links: DataFrame, anchor: int) -> DataFrame:
    """(node): the anchor's component; none if no link has the anchor."""
    c = components(links)
    return c.join(c.filter(F.col("node") == anchor).select("comp"), "comp", "left_semi").select("node")


def joined_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links of a component. nodes: all its nodes, so both ends of a link are among them or neither."""
    return links.join(nodes.select(F.col("node").alias("u")).hint("merge"), "u", "left_semi")


def island_links(links: DataFrame, places: DataFrame, mainland: int) -> DataFrame:
    """places(place, node): joined to the mainland at all, and only by ferry.

    What is joined by road is joined, so roads are looked at in the mainland's component only.
    """
    joined = joined_nodes(links, mainland)
    by_road = joined_nodes(joined_links(links, joined).filter("NOT ferry"), mainland)
    out = places
    for name, nodes in (("joined", joined), ("by_road", by_road)):
        out = out.join(nodes.withColumn(name, F.lit(True)).hint("merge"), "node", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select("place", "node", "joined", (F.col("joined") & ~F.col("by_road")).alias("via_ferry"))


def reachable(
    links: DataFrame, cuts: DataFrame, scenarios: DataFrame, anchor: int, scenario: list[str],
) -> DataFrame:
    """(scenario.., node) for every node still joined to the anchor.

    Cuts only take links away, so all work is on the anchor's component in the whole network.
    Links no scenario cuts are contracted once. Only the others are repeated per scenario, between
    the contracted parts. scenarios: scenario columns + network_id, joined to links.network_id by
    equality.
    """
    work = WorkTables(links.sparkSession, "reachable")
    links = work.save(joined_links(links, joined_nodes(links, anchor)))
    ever = cuts.select("link_id").distinct()
    base = components(links.join(ever, "link_id", "left_anti"))
    label_u = base.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
    label_v = base.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    loose = (
        links.join(ever, "link_id", "left_semi")
        .join(label_u, "u", "left").join(label_v, "v", "left")
        .select(
            "network_id", "link_id", F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")
        )
    )
    open_links = (
        measured_join(loose, scenarios, ["network_id"], "link_id").join(cuts, [*scenario, "link_id"], "left_anti")
    )
    open_links = work.save(open_links.select(*scenario, "u", "v"))
    parts = components(open_links, scenario)
    # Contracted parts without an open loose link in a scenario stay on their own.
    nodes = links.select("network_id", F.explode(F.array("u", "v")).alias("node")).distinct().join(
        base, "node", "left"
    ).select("network_id", "node", F.coalesce("comp", "node").alias("part"))
    nodes = work.save(nodes)
    part_label = parts.select(*scenario, F.col("node").alias("part"), F.col("comp").alias("root"))
    home_part = nodes.filter(F.col("node") == anchor).select("network_id", F.col("part").alias("home"))
    per_scn = scenarios.join(home_part, "network_id")
    home = per_scn.join(
        part_label.select(*scenario, F.col("part").alias("home"), F.col("root").alias("home_root")),
        [*scenario, "home"], "left",
    ).select(*scenario, "home", F.coalesce("home_root", "home").alias("home_root"))
    # The parts in the anchor's component: from the loose links, plus the anchor's own part.
    near = (
        part_label.join(home.select(*scenario, "home_root"), scenario)
        .filter(F.col("root") == F.col("home_root"))
        .select(*scenario, "part")
        .unionByName(home.select(*scenario, F.col("home").alias("part")))
        .distinct()
    )
    return near.join(nodes.select("node", "part"), "part").select(*scenario, "node")


# --- Shortest paths ------------------------------------------------------------------------------


def nearest_source(
    links: DataFrame, sources: DataFrame, scenario: list[str] | None = None,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """(scenario.., node, dist, source, via_node, via_link): the nearest source of every node.

    sources: scenario.., source, node. Ties go to the lower (distance, source, next node, link).
    Only nodes that improved are relaxed in the next round; scenario-closed links are taken out
    of the frontier's moves, so links are never copied per scenario.
    """
    scn = scenario or []
    work = WorkTables(links.sparkSession, "nearest")
    hops = work.save(both_ways(links))
    cuts = None if cuts is None else work.save(cuts.select(*scn, "link_id"))
    best = ["dist", "source", "via_node", "via_link"]
    nobody = F.lit(None).cast("long")
    state = work.save(
        sources.groupBy(*scn, "node")
        .agg(F.min("source").alias("source"))
        .select(
            *scn, "node", F.lit(0.0).alias("dist"), "source", nobody.alias("via_node"),
            nobody.alias("via_link"), F.lit(True).alias("changed"),
        )
    )

    def relaxed(state: DataFrame) -> DataFrame:
        moves = state.filter("changed").select(*scn, F.col("node").alias("n"), "dist", "source").join(hops, "n")
        if cuts is not None:
            moves = moves.join(cuts, [*scn, "link_id"], "left_anti")
        offer = F.struct(
            (F.col("dist") + F.col("tt").cast("double")).alias("dist"), "source",
            F.col("n").alias("via_node"), F.col("link_id").alias("via_link"),
        )
        offers = moves.select(*scn, F.col("m").alias("node"), offer.alias("pick"), F.lit(None).alias("old"))
        known = state.select(*scn, "node", F.struct(*best).alias("pick"), F.struct(*best).alias("old"))
        # State and offers meet in one aggregation: offers combine map-side, nothing is joined.
        return (
            known.unionByName(offers).groupBy(*scn, "node")
            .agg(F.min("pick").alias("pick"), F.min("old").alias("old"))
            .withColumn("changed", F.coalesce(F.col("pick") < F.col("old"), F.lit(True)))
            .select(*scn, "node", *[F.col(f"pick.{c}").alias(c) for c in best], "changed")
        )

    while True:
        # What the first step changed has made its offers in the second; only the last step's changes wait.
        for _ in range(STEPS_PER_ROUND):
            state = relaxed(state)
        state, changed = work.save_counting(state, "changed")
        if changed == 0:
            work.keep_last()
            return state.drop("changed")


def k_nearest_sources(
    links: DataFrame, sources: DataFrame, k: int = 2, scenario: list[str] | None = None,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """(scenario.., node, rank, source, dist): the k nearest distinct sources of every node."""
    scn = scenario or []
    work = WorkTables(links.sparkSession, "k-nearest")
    hops = work.save(both_ways(links))
    cuts = None if cuts is None else work.save(cuts.select(*scn, "link_id"))
    order = Window.partitionBy(*scn, "node").orderBy("dist", "source")
    state = sources.select(*scn, "node", "source", F.lit(0.0).alias("dist"), F.lit(True).alias("changed"))
    state = work.save(
        state.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    )
    while True:
        moves = state.filter("changed").select(*scn, F.col("node").alias("n"), "dist", "source").join(hops, "n")
        if cuts is not None:
            moves = moves.join(cuts, [*scn, "link_id"], "left_anti")
        offers = moves.select(
            *scn, F.col("m").alias("node"), "source", (F.col("dist") + F.col("tt").cast("double")).alias("dist"),
            F.lit(None).cast("double").alias("old"),
        )
        kept = state.select(*scn, "node", "source", "dist", F.col("dist").alias("old"))
        merged = (
            kept.unionByName(offers)
            .groupBy(*scn, "node", "source")
            .agg(F.min("dist").alias("dist"), F.min("old").alias("old"))
            .withColumn("changed", F.coalesce(F.col("dist") < F.col("old"), F.lit(True)))
        )
        state, changed = work.save_counting(
            merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("old"),
            "changed",
        )
        if changed == 0:
            work.keep_last()
            return state.drop("changed")


def paths(tree: DataFrame, starts: DataFrame, scenario: list[str] | None = None) -> DataFrame:
    """(scenario.., item, pos, u, v, link_id): every item's hops to its source, all at once.

    tree: output of nearest_source; starts: scenario.., item, node.
    """
    scn = scenario or []
    work = WorkTables(tree.sparkSession, "paths")
    step = WorkTables(tree.sparkSession, "path-steps").save(
        tree.filter("via_node IS NOT NULL").select(*scn, "node", "via_node", "via_link")
    )
    here = starts.select(*scn, "item", "node")
    for first in count(0, HOPS_PER_ROUND):
        walked, at = here.withColumn("n0", F.col("node")).drop("node"), []
        for i in range(HOPS_PER_ROUND):
            nxt = step.select(
                *scn, F.col("node").alias(f"n{i}"), F.col("via_node").alias(f"n{i + 1}"),
                F.col("via_link").alias(f"l{i}"),
            )
            walked = walked.join(nxt, [*scn, f"n{i}"], "left")
            at.append(
                F.struct(
                    F.lit(first + i).alias("pos"), F.col(f"n{i}").alias("u"),
                    F.col(f"n{i + 1}").alias("v"), F.col(f"l{i}").alias("link_id"),
                )
            )
        hop, found = work.save_counting(
            walked.select(*scn, "item", F.explode(F.array(*at)).alias("h"))
            .select(*scn, "item", "h.pos", "h.u", "h.v", "h.link_id")
            .filter("v IS NOT NULL")
            .withColumn("last", F.col("pos") == first + HOPS_PER_ROUND - 1),
            "last",
        )
        if found == 0:
            return work.union(work.paths, hop.schema).drop("last")
        here = hop.filter("last").select(*scn, "item", F.col("v").alias("node"))


def first_cut(
    hops: DataFrame, links: DataFrame, cuts: DataFrame, scenario: list[str]
) -> DataFrame:
    """(scenario.., item, pos, link_id): the first hop whose parallel links are all cut.

    hops are the usual (uncut) path: item, pos, u, v. The link reported is the pair's fastest.
    """
    pairs = fastest(links).select("u", "v", F.col("link_id").alias("fast"), "parallel")
    closed = (
        cuts.join(links.select("link_id", "u", "v"), "link_id")
        .groupBy(*scenario, "u", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(pairs, ["u", "v"])
        .filter("n = parallel")
        .select(*scenario, F.col("u").alias("a"), F.col("v").alias("b"), "fast")
    )
    return (
        hops.withColumn("a", F.least("u", "v"))
        .withColumn("b", F.greatest("u", "v"))
        .join(closed, ["a", "b"])
        .groupBy(*scenario, "item")
        .agg(F.min("pos").alias("pos"), F.min_by("fast", "pos").alias("link_id"))
    )


def baseline_access(
    facilities: DataFrame, anchor_tree: DataFrame, two_nearest: DataFrame, access: DataFrame
) -> DataFrame:
    """Per facility (item, node, too_far): time from the anchor, and to the nearest access source;
    for an access source itself, the nearest other one. access: item (the sources' ids)."""
    base = anchor_tree.select("node", F.col("dist").alias("baseline_s"))
    near = two_nearest.groupBy("node").agg(
        F.max(F.when(F.col("rank") == 1, F.col("source"))).alias("s1"),
        F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("d2"),
    )
    is_source = access.select("item", F.lit(True).alias("is_source"))
    own = F.coalesce(F.col("is_source"), F.lit(False)) & (F.col("s1") == F.col("item"))
    near_enough = ~F.col("too_far")
    return (
        facilities.join(base, "node", "left").join(near, "node", "left").join(is_source, "item", "left")
        .select(
            "item", "node", "too_far",
            F.when(near_enough, F.floor(F.col("baseline_s") + F.lit(0.5)).cast("long")).alias("baseline_travel_time_s"),
            F.when(
                near_enough, F.floor(F.when(own, F.col("d2")).otherwise(F.col("d1")) + F.lit(0.5)).cast("long")
            ).alias("hospital_travel_time_s"),
        )
    )


# --- Simplification and legs ---------------------------------------------------------------------


def simplify(links: DataFrame) -> DataFrame:
    """Runs of links through nodes of degree two, equal in way and connector, become one link.

    Ways never merge with each other and every component stays. Closed runs keep their lowest node
    at both ends.
    """
    at = links.select(
        "link_id", "way_id", "connector", F.explode(F.array("u", "v")).alias("node")
    )
    inner = (
        at.groupBy("node")
        .agg(
            F.count(F.lit(1)).alias("degree"),
            F.min(F.struct("way_id", "connector")).alias("lo"),
            F.max(F.struct("way_id", "connector")).alias("hi"),
            F.min("link_id").alias("a"), F.max("link_id").alias("b"),
        )
        .filter("degree = 2 AND lo = hi")
    )
    runs = components(inner.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(
        F.col("node").alias("link_id"), F.col("comp").alias("run")
    )
    tagged = links.join(runs, "link_id", "left").withColumn("run", F.coalesce("run", "link_id"))
    ends = (
        tagged.select("run", F.explode(F.array("u", "v")).alias("node"))
        .join(inner.select("node", F.lit(True).alias("inside")), "node", "left")
        .groupBy("run")
        .agg(
            F.min(F.when(F.col("inside").isNull(), F.col("node"))).alias("lo"),
            F.max(F.when(F.col("inside").isNull(), F.col("node"))).alias("hi"),
            F.min("node").alias("any"),
        )
    )
    whole = tagged.groupBy("run").agg(
        F.min("way_id").alias("way_id"), F.bool_or("ferry").alias("ferry"),
        F.bool_or("connector").alias("connector"), F.sum("tt").alias("tt"),
        F.count(F.lit(1)).alias("pieces"),
    )
    return whole.join(ends, "run").select(
        F.col("run").alias("link_id"), F.coalesce("lo", "any").alias("u"), F.coalesce("hi", "any").alias("v"),
        "way_id", "ferry", "connector", "tt", "pieces",
    )


def legs(hops: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive hops by the same mode along each path: keys.., leg, ferry, from, to, seconds."""
    w = Window.partitionBy(*keys).orderBy("pos")
    turned = F.lag("ferry").over(w) != F.col("ferry")
    return (
        hops.join(links.select("link_id", "ferry", "tt"), "link_id")
        .withColumn("turn", F.when(turned, 1).otherwise(0))
        .withColumn("leg", F.sum("turn").over(w))
        .groupBy(*keys, "leg", "ferry")
        .agg(
            F.min_by("u", "pos").alias("from_node"), F.max_by("v", "pos").alias("to_node"),
            F.sum("tt").alias("seconds"), F.count(F.lit(1)).alias("hops"),
        )
    )
