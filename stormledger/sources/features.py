"""Feature files: tagged elements, GeoJSON, commented CSV, feature parquet, ways to links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.functions.labels import kind_rank

POINT = "struct<lat: double, lon: double>"
ELEMENT = (
    f"type string, id long, lat double, lon double, center {POINT}, tags map<string,string>, nodes array<long>, "
    f"geometry array<{POINT}>, members array<struct<type: string, ref: long, role: string, geometry: array<{POINT}>>>"
)
INFRA_ORDER = ["road", "power_line", "substation", "hospital", "shelter"]


def read_elements(spark: SparkSession, *paths: str) -> DataFrame:
    """Elements of one or more response files (one JSON object per line, or one per file)."""
    out = None
    for i, path in enumerate(paths):
        one = (
            spark.read.schema(f"elements array<struct<{_inner(ELEMENT)}>>").json(path)
            .select(F.lit(i).alias("response"), F.posexplode("elements").alias("pos", "e"))
            .select("response", "pos", "e.*")
        )
        out = one if out is None else out.unionByName(one)
    return out


def _inner(ddl: str) -> str:
    """A column list as struct fields: "a long, b .." to "a: long, b: .."."""
    parts, depth, field = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = field.strip().split(" ", 1)
            parts.append(f"{name}: {kind}")
            field = ""
        else:
            field += ch
    return ", ".join(parts)


def read_geojson(spark: SparkSession, path: str, properties: str, geometry: str, multi_line: bool = True) -> DataFrame:
    """FeatureCollection files (multi_line) or one feature per line (at scale) to feature rows.

    properties: the fields as "name: type, .."; geometry: the type of the coordinates.
    """
    props, shape = f"struct<{properties}>", f"struct<type: string, coordinates: {geometry}>"
    if multi_line:
        feature = f"struct<type: string, id: string, properties: {props}, geometry: {shape}>"
        rows = spark.read.schema(f"features array<{feature}>").option("multiLine", True).json(path)
        return rows.select(F.explode("features").alias("f")).select("f.id", "f.properties.*", "f.geometry")
    lines = spark.read.schema(f"type string, id string, properties {props}, geometry {shape}").json(path)
    return lines.select("id", "properties.*", "geometry")


def read_commented(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """CSV under a '#' comment header, every column as text (leading zeros kept), blanks as null,
    with the file order in `ord`."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.csv(path, schema=schema, header=header, comment="#")
    return df.withColumn("ord", F.monotonically_increasing_id())


def best_copy(elements: DataFrame, kind: str = "kind") -> DataFrame:
    """One copy per element: the better kind, else the first seen. An aggregation, so an element
    repeated in many responses is reduced map-side."""
    rest = [c for c in elements.columns if c not in ("type", "id")]
    order = F.struct(kind_rank(F.col(kind)), F.col("response"), F.col("pos"))
    return elements.groupBy("type", "id").agg(F.min_by(F.struct(*rest), order).alias("x")).select("type", "id", "x.*")


def feature_id(infra_type: Column, osm_type: Column, number: Column) -> Column:
    return F.concat_ws("-", F.replace(infra_type, F.lit("_"), F.lit("-")), osm_type, number.cast("string"))


def way_of(osm_id: Column) -> Column:
    return F.when(osm_id.startswith("way/"), F.split_part(osm_id, F.lit("/"), F.lit(2)).cast("long"))


def road_index(features: DataFrame) -> DataFrame:
    return features.filter("infra_type = 'road'").select(way_of(F.col("osm_id")).alias("way_id"), F.col("id").alias("road_id")).filter("way_id IS NOT NULL")


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").partitionBy("infra_type").parquet(path)


def read_features(spark: SparkSession, path: str, infra_type: str | None = None) -> DataFrame:
    """The stored features; a type filter prunes partitions."""
    df = spark.read.parquet(path)
    return df if infra_type is None else df.filter(F.col("infra_type") == infra_type)


def parsed_attributes(features: DataFrame, text: str = "attributes") -> DataFrame:
    """Attributes from their JSON text, null-like names cleaned, a sortable type order."""
    order = F.array_position(F.array(*[F.lit(t) for t in INFRA_ORDER]), F.col("infra_type"))
    name = F.nullif(F.nullif(F.trim("name"), F.lit("")), F.lit("nan"))
    return features.withColumn("attrs", F.from_json(text, "map<string,string>")).withColumn("name", name).withColumn("type_ord", order)


def way_edges(ways: DataFrame) -> DataFrame:
    """Consecutive node pairs of each way with both coordinates; node and coordinate lists that
    do not align are an error."""
    aligned = F.assert_true(
        (F.size("nodes") == F.size("geometry")) & (F.size("nodes") >= 2),
        F.concat(F.lit("node ids missing or not aligned with geometry in way "), F.col("id").cast("string")),
    )
    zipped = F.arrays_zip(F.col("nodes"), F.col("geometry"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("nodes") - 1),
        lambda i: F.struct(
            i.alias("seq"), F.element_at(zipped, i)["nodes"].alias("u"), F.element_at(zipped, i + 1)["nodes"].alias("v"),
            F.element_at(zipped, i)["geometry"].alias("a"), F.element_at(zipped, i + 1)["geometry"].alias("b"),
        ),
    )
    checked = ways.withColumn("ok", aligned).filter(F.col("ok").isNull())
    return checked.select(F.col("id").alias("way_id"), F.explode(pairs).alias("e")).select("way_id", "e.*")


def way_nodes(ways: DataFrame) -> DataFrame:
    """node_id, x, y: each node once (its lowest way decides)."""
    z = ways.select("id", F.explode(F.arrays_zip("nodes", "geometry")).alias("p"))
    return z.groupBy(F.col("p.nodes").alias("node_id")).agg(F.min_by("p.geometry", "id").alias("g")).select(
        "node_id", F.col("g.lon").alias("x"), F.col("g.lat").alias("y")
    )


def write_network(nodes: DataFrame, links: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    links.write.mode("overwrite").parquet(f"{path}/links")


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/links")


def ingest_report(features: DataFrame, attribute: str) -> DataFrame:
    """Counts per type, per attribute value, and in all."""
    counted = features.groupingSets([["infra_type", attribute], ["infra_type"], []], "infra_type", attribute)
    return counted.agg(F.count(F.lit(1)).alias("n"))


def clip_points(points: DataFrame, shapes: DataFrame, tile: float) -> DataFrame:
    from stormledger.operators.spatial import containing

    inside = containing(points.select("pid", "x", "y"), shapes, tile, boundary=True).select("pid").distinct()
    return points.join(inside, "pid", "left_semi")


def drop_node_copies(nodes: DataFrame, areas: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """(kept nodes, (pid, area_id, level)): a node inside a facility polygon goes into it; the area
    takes the higher level. areas: zone_id, ord, ring."""
    from stormledger.operators.spatial import containing

    hit = containing(nodes, areas, tile).groupBy("pid").agg(
        F.min_by("zone_id", "ord").alias("area_id"), F.max("level").alias("level")
    )
    return nodes.join(hit.select("pid"), "pid", "left_anti"), hit


