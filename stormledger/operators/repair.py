"""Networks under many cut sets: one stored shortest-path tree, repaired where cuts touch it.

A cut of a link that no stored route uses changes nothing. A cut of a tree link loses the nodes
behind it, up to the next cut further out: a part. Per scenario only

* lost nodes are found, by following the tree outwards from its cut links,
* parts are joined again, to each other or to what is not lost, by open links beside the tree,
* nodes of parts joined again are given routes anew, from the offers of neighbours that are not
  lost inwards; a round writes the rows it changed, nothing else.

All that is not lost keeps its stored route, ties included: cuts only take offers away, and the
stored one is still there. So the rows follow what cuts take off, not scenarios times nodes.

tree: node, dist, source, via_node, via_link, as from network.nearest_source on the whole network.
cuts: scenario columns + link_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormledger.operators import network as N
from stormledger.session import WorkTables

STEPS_PER_ROUND = 3
OUTSIDE = -(1 << 62)  # stands for all that is not lost; lower than any node, so it names its component
PICK = ["dist", "source", "via_node", "via_link"]


def lost_nodes(tree: DataFrame, cuts: DataFrame, scenario: list[str]) -> DataFrame:
    """(scenario.., node, part): nodes whose route has a cut link; part is the node behind the nearest such link."""
    work, held = WorkTables(tree.sparkSession, "lost"), WorkTables(tree.sparkSession, "lost-steps")
    step = held.save(tree.filter("via_node IS NOT NULL").select("node", "via_node", "via_link"))
    heads = held.save(
        cuts.select(*scenario, F.col("link_id").alias("via_link")).distinct().join(step, "via_link").select(*scenario, "node")
    )
    front = heads.select(*scenario, "node", F.col("node").alias("part"), F.lit(True).alias("last"))
    front, left = work.save_counting(front, "last")
    while left:
        walked, at = front.filter("last").select(*scenario, "part", F.col("node").alias("n0")), []
        for k in range(1, STEPS_PER_ROUND + 1):
            out = step.select(F.col("via_node").alias(f"n{k - 1}"), F.col("node").alias("next"))
            own = heads.select(*scenario, F.col("node").alias("next"), F.lit(True).alias("headed"))
            walked = (
                walked.join(out, f"n{k - 1}", "left").join(own, [*scenario, "next"], "left")
                .withColumn(f"n{k}", F.when(F.col("headed").isNull(), F.col("next"))).drop("next", "headed")
            )
            at.append(F.struct(F.col(f"n{k}").alias("node"), F.lit(k == STEPS_PER_ROUND).alias("last")))
        front, left = work.save_counting(
            walked.select(*scenario, "part", F.inline(F.array(*at))).filter("node IS NOT NULL").distinct()
            .select(*scenario, "node", "part", "last"),
            "last",
        )
    return work.union(work.paths, front.schema).drop("last")


def apart(links: DataFrame, tree: DataFrame, cuts: DataFrame, lost: DataFrame, scenario: list[str]) -> DataFrame:
    """(scenario.., part): the parts that no open link joins to the rest again."""
    beside = links.join(tree.select(F.col("via_link").alias("link_id")), "link_id", "left_anti")
    end = lost.select(*scenario, F.col("node").alias("m"), F.col("part").alias("other"))
    joints = (
        lost.join(N.both_ways(beside).select(F.col("n").alias("node"), "m", "link_id"), "node")
        .join(cuts.select(*scenario, "link_id"), [*scenario, "link_id"], "left_anti")
        .join(end, [*scenario, "m"], "left")
        .select(*scenario, F.col("part").alias("u"), F.coalesce("other", F.lit(OUTSIDE)).alias("v"))
        .filter("u <> v").distinct()
    )
    joined = N.components(WorkTables(links.sparkSession, "joints").save(joints), scenario)
    back = joined.filter(F.col("comp") == OUTSIDE).select(*scenario, F.col("node").alias("part"))
    return lost.select(*scenario, "part").distinct().join(back, [*scenario, "part"], "left_anti")


def cut_off(links: DataFrame, tree: DataFrame, cuts: DataFrame, scenario: list[str]) -> DataFrame:
    """(scenario.., node): nodes of the tree that no source is reached from any more."""
    lost = lost_nodes(tree, cuts, scenario)
    return lost.join(apart(links, tree, cuts, lost, scenario), [*scenario, "part"], "left_semi").select(*scenario, "node")


def repaired(links: DataFrame, tree: DataFrame, cuts: DataFrame, lost: DataFrame, scenario: list[str]) -> DataFrame:
    """(scenario.., node, dist, source, via_node, via_link) of the lost nodes that have a route left.

    Ties go as in nearest_source. Nodes without a row are either not lost or cut off.
    """
    held, work = WorkTables(links.sparkSession, "repair-links"), WorkTables(links.sparkSession, "repair")
    hops = held.save(N.both_ways(links).select("n", "m", "link_id", F.col("tt").cast("double").alias("tt")))
    closed = cuts.select(*scenario, "link_id")
    lost = lost.select(*scenario, "node")
    pick = F.struct(
        (F.col("dist") + F.col("tt")).alias("dist"), "source", F.col("n").alias("via_node"), F.col("link_id").alias("via_link")
    ).alias("pick")
    # The rim: open links from a lost node to one that kept its route.
    offers = (
        lost.join(hops.select(F.col("m").alias("node"), "n", "link_id", "tt"), "node")
        .join(closed, [*scenario, "link_id"], "left_anti")
        .join(lost.withColumnRenamed("node", "n"), [*scenario, "n"], "left_anti")
        .join(tree.select(F.col("node").alias("n"), "dist", "source"), "n")
        .select(*scenario, "node", pick)
    )
    known = None
    while True:
        best = offers.groupBy(*scenario, "node").agg(F.min("pick").alias("pick"))
        if known is not None:
            best = best.join(known, [*scenario, "node"], "left").filter(F.col("old").isNull() | (F.col("pick") < F.col("old")))
        changed, n = work.save_counting(best.select(*scenario, "node", "pick", F.lit(True).alias("changed")), "changed")
        if not n:
            break
        known = work.union(work.paths, changed.schema).groupBy(*scenario, "node").agg(F.min("pick").alias("old"))
        offers = (
            changed.select(*scenario, F.col("node").alias("n"), "pick.dist", "pick.source").join(hops, "n")
            .join(closed, [*scenario, "link_id"], "left_anti")
            .select(*scenario, F.col("m").alias("node"), pick)
            .join(lost, [*scenario, "node"], "left_semi")
        )
    found = work.union(work.paths, changed.schema).groupBy(*scenario, "node").agg(F.min("pick").alias("pick"))
    return WorkTables(links.sparkSession, "repaired").save(found.select(*scenario, "node", "pick.*"))


def repaired_paths(tree: DataFrame, repairs: DataFrame, starts: DataFrame, scenario: list[str]) -> DataFrame:
    """(scenario.., item, pos, u, v, link_id): every item's hops to its source; a repaired node's own hop goes before the stored one.

    starts: scenario.., item, node. Nodes on a route that starts from a node with a route have one.
    """
    work = WorkTables(tree.sparkSession, "repaired-paths")
    stored = tree.filter("via_node IS NOT NULL").select("node", F.struct("via_node", "via_link").alias("stored"))
    anew = repairs.select(*scenario, "node", F.struct("via_node", "via_link").alias("anew"))
    here, first = starts.select(*scenario, "item", "node"), 0
    while True:
        walked, at = here.withColumn("n0", F.col("node")).drop("node"), []
        for k in range(STEPS_PER_ROUND):
            walked = (
                walked.join(anew.withColumnRenamed("node", f"n{k}"), [*scenario, f"n{k}"], "left")
                .join(stored.withColumnRenamed("node", f"n{k}"), f"n{k}", "left")
                .withColumn("hop", F.coalesce("anew", "stored"))
                .withColumns({f"n{k + 1}": F.col("hop.via_node"), f"l{k}": F.col("hop.via_link")}).drop("hop", "anew", "stored")
            )
            at.append(F.struct(
                F.lit(first + k).alias("pos"), F.col(f"n{k}").alias("u"), F.col(f"n{k + 1}").alias("v"), F.col(f"l{k}").alias("link_id")))
        hop, n = work.save_counting(
            walked.select(*scenario, "item", F.inline(F.array(*at))).filter("v IS NOT NULL")
            .withColumn("last", F.col("pos") == first + STEPS_PER_ROUND - 1),
            "last",
        )
        if not n:
            return work.union(work.paths, hop.schema).drop("last")
        here, first = hop.filter("last").select(*scenario, "item", F.col("v").alias("node")), first + STEPS_PER_ROUND


def last_open_step(items: DataFrame, closed: DataFrame, axis: DataFrame) -> DataFrame:
    """(item, deadline, stays_open): the step before an item's first closed one.

    items: item, network_id, always_closed; closed: item, step (only steps that are closed);
    axis: network_id, step. Nothing is compared per item and step: an item has its first closed
    step, and the axis knows which step comes before it.
    """
    steps = axis.select("network_id", "step").distinct()
    order = Window.partitionBy("network_id").orderBy("step")  # the steps of one network
    before = steps.select("network_id", F.col("step").alias("closed"), F.lag("step").over(order).alias("previous"))
    ends = steps.groupBy("network_id").agg(F.min("step").alias("start"), F.max("step").alias("end"))
    first = closed.groupBy("item").agg(F.min("step").alias("closed"))
    return (
        items.join(first, "item", "left").join(ends, "network_id")
        .withColumn("closed", F.when(F.col("always_closed"), F.col("start")).otherwise(F.col("closed")))
        .join(before, ["network_id", "closed"], "left")
        .select(
            "item", F.when(F.col("closed").isNull(), F.col("end")).otherwise(F.col("previous")).alias("deadline"),
            F.col("closed").isNull().alias("stays_open"),
        )
    )

