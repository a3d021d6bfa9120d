"""Predicted against observed: confusion counts, metrics, scene selection, two-source checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions.numeric import clip, fixed_text, ratio, round_to


def status(predicted: Column, observed: Column) -> Column:
    return (
        F.when(predicted & observed, F.lit("tp")).when(predicted, F.lit("fp")).when(observed, F.lit("fn")).otherwise(F.lit("tn"))
    )


def confusion(cells: DataFrame, zones: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Counts and proportional areas per zone. cells: zone, predicted, observed (observed is
    required input: nothing is guessed from terrain). zones: zone, area_km2."""
    p, o = F.col("predicted"), F.col("observed")
    c = cells.groupBy(zone).agg(
        F.count_if(p & o).alias("tp"), F.count_if(p & ~o).alias("fp"), F.count_if(~p & o).alias("fn"),
        F.count_if(~p & ~o).alias("tn"), F.count(F.lit(1)).alias("cells"),
    )
    each = F.col("area_km2") / F.greatest(F.col("cells"), F.lit(1))
    return c.join(zones.select(zone, "area_km2"), zone).select(
        zone, "tp", "fp", "fn", "tn", *[(F.col(x) * each).alias(f"{x}_km2") for x in ("tp", "fp", "fn", "tn")]
    )


def metrics(conf: DataFrame, zone: str = "zone_id", digits: int = 4) -> DataFrame:
    """IoU, precision, recall, F1, accuracy, specificity, kappa and area agreement; 0 for 0 / 0."""
    tp, fp, fn, tn = (F.col(f"{x}_km2") for x in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    accuracy = ratio(tp + tn, total)
    chance = ratio(tp + fp, total) * ratio(tp + fn, total) + ratio(tn + fn, total) * ratio(tn + fp, total)
    kappa = F.when(total > 0, ratio(accuracy - chance, F.when(F.lit(1.0) - chance > 1e-6, F.lit(1.0) - chance).otherwise(0.0))).otherwise(0.0)
    larger = F.greatest(tp + fn, tp + fp, F.lit(1e-6))
    agreement = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(fn - fp) / larger)
    out = {
        "iou": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1_score": ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), "accuracy": accuracy,
        "specificity": ratio(tn, tn + fp), "kappa": clip(kappa, -1.0, 1.0), "area_agreement": agreement,
    }
    return conf.select(zone, *[round_to(v, digits).alias(k) for k, v in out.items()])


def macro(metric_rows: DataFrame, names: list[str]) -> DataFrame:
    return metric_rows.agg(*[F.avg(n).alias(f"mean_{n}") for n in names], F.count(F.lit(1)).alias("zones"))


def scene_pair(catalogue: DataFrame, events: DataFrame, before_days: int = 14, after_days: int = 7) -> DataFrame:
    """Per area the earliest scene after its event and the latest before it, same orbit first, else
    same pass. catalogue: area, scene, ts, orbit, orbit_pass; events: area, at.

    Two aggregations per area over rows inside the windows; the candidates are never listed.
    """
    near = catalogue.join(events, "area")
    after = near.filter((F.col("ts") >= F.col("at")) & (F.col("ts") < F.col("at") + F.make_interval(days=F.lit(after_days))))
    post = after.groupBy("area").agg(F.min(F.struct("ts", "scene", "orbit", "orbit_pass")).alias("post"))
    before = near.filter((F.col("ts") < F.col("at")) & (F.col("ts") >= F.col("at") - F.make_interval(days=F.lit(before_days))))
    matched = before.join(post, "area").filter(F.col("orbit_pass") == F.col("post.orbit_pass"))
    same_orbit = F.when(F.col("orbit") == F.col("post.orbit"), F.struct("ts", "scene"))
    pre = matched.groupBy("area").agg(F.max(same_orbit).alias("orbit_match"), F.max(F.struct("ts", "scene")).alias("pass_match"))
    pick = F.coalesce("orbit_match", "pass_match")
    return post.join(pre, "area", "left").select(
        "area", F.col("post.scene").alias("post_scene"), pick["scene"].alias("pre_scene"),
        F.coalesce(F.col("orbit_match").isNotNull(), F.lit(False)).alias("same_orbit"),
    )


def two_source_check(a: DataFrame, b: DataFrame, key: str, tolerance: float = 0.005) -> DataFrame:
    """Values of two sources side by side, verified where they differ by at most the tolerance."""
    off = F.abs(F.try_divide(F.col("a") - F.col("b"), F.col("b")))
    return a.join(b, key, "left").withColumn("verified", F.coalesce(off <= tolerance, F.lit(False)))


def zone_alias(zones: DataFrame) -> DataFrame:
    """(alias, zone_id): code, zero-padded code, name and slug, for lookups by any of them."""
    code = F.col("zone_id").cast("string")
    slug = F.lower(F.replace(F.trim("zone_name"), F.lit(" "), F.lit("_")))
    return zones.select(
        F.explode(F.array_distinct(F.array(code, F.lpad(code, 5, "0"), F.lower("zone_name"), slug))).alias("alias"), "zone_id"
    )


def overview(zones: DataFrame, metric_map: DataFrame, names: list[str]) -> DataFrame:
    """Flat summary rows with 0 for metrics a zone does not have. metric_map: zone_id, metrics map."""
    m = F.coalesce("metrics", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    return zones.join(metric_map, "zone_id", "left").select(
        "zone_id", *[F.coalesce(F.element_at(m, n), F.lit(0.0)).alias(n) for n in names]
    )


def report(metric_rows: DataFrame, zone: str, names: list[str], title: str) -> DataFrame:
    """A Markdown table as ordered lines (ord, line): heading, one line per zone, the means. Figures are
    written by their exact values (see fixed_text); a line is null where a zone or figure in it is."""
    head = metric_rows.sparkSession.createDataFrame(
        [(0, "", f"# {title}"), (1, "", "| zone | " + " | ".join(names) + " |"), (2, "", "|" + "---|" * (len(names) + 1))],
        "ord int, sub string, line string",
    )

    def line(label: Column, figures: list[Column]) -> Column:
        cells = [x for f in figures for x in (F.lit(" | "), fixed_text(f, 4))]
        return F.concat(F.lit("| "), label, *cells, F.lit(" |")).alias("line")

    body = metric_rows.select(
        F.lit(3).alias("ord"), F.col(zone).cast("string").alias("sub"),
        line(F.col(zone).cast("string"), [F.col(n) for n in names]),
    )
    means = metric_rows.agg(*[F.avg(n).alias(n) for n in names]).select(
        F.lit(4).alias("ord"), F.lit("").alias("sub"), line(F.lit("mean"), [F.col(n) for n in names])
    )
    return head.unionByName(body).unionByName(means).orderBy("ord", "sub")
