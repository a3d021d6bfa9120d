"""Stored results: compact rows, content de-duplication, re-attached geometry, exports, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def compact(results: DataFrame) -> DataFrame:
    """Only the rows that say something."""
    return results.filter("status <> 'ok'")


def expand(stored: DataFrame, infra: DataFrame, hazards: list[str], keys: list[str]) -> DataFrame:
    """The full set again: every feature under every hazard, 'ok' where nothing is stored.

    infra carries the key columns besides the hazard. The hazards unfold per feature.
    """
    full = infra.withColumn("hazard", F.explode(F.array(*[F.lit(h) for h in hazards])))
    return full.join(stored.select(*keys, "hazard", "status"), [*keys, "hazard"], "left").withColumn(
        "status", F.coalesce("status", F.lit("ok"))
    )


def leftovers(stored: DataFrame, infra: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows of unknown features; must be empty."""
    return stored.join(infra.select(*keys).distinct(), keys, "left_anti")


def fingerprint(*columns: str) -> list[Column]:
    """An order-free content hash of a group of rows as three combinable aggregates."""
    return [
        F.count(F.lit(1)).alias("fp_n"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("fp_a"),
        F.sum(F.xxhash64(F.lit(17), *columns).cast("decimal(38,0)")).alias("fp_b"),
    ]


def dedup_content(results: DataFrame, step: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(index(step, content), content rows): each distinct step content once.

    A step's rows are never gathered: its hash is a sum of row hashes, combined map-side.
    """
    per = results.groupBy(step).agg(*fingerprint(*columns))
    key = F.sha2(F.concat_ws("|", F.col("fp_n").cast("string"), F.col("fp_a").cast("string"), F.col("fp_b").cast("string")), 256)
    index = per.select(step, key.alias("content"))
    first = index.groupBy("content").agg(F.min(step).alias(step))
    return index, results.join(first, step).drop(step)


def restore(index: DataFrame, content: DataFrame) -> DataFrame:
    return index.join(content, "content").drop("content")


def attach(facts: DataFrame, dimension: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(facts with the dimension's columns, facts of unknown keys)."""
    return facts.join(dimension, key), facts.join(dimension.select(key), key, "left_anti")


def export_artifacts(rows: DataFrame, path: str, zone: str = "zone_id", layer: str = "layer") -> None:
    rows.write.mode("overwrite").partitionBy(zone, layer).json(path)


def html_rows(pages: DataFrame, html: str, row_pattern: str, cell_pattern: str) -> DataFrame:
    """(page_id, row_no, cells): rows of a page by pattern, cells stripped of tags."""
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))
    rows = F.regexp_extract_all(F.col(html), F.lit(row_pattern), F.lit(0))
    return pages.select("page_id", F.posexplode(rows).alias("row_no", "row")).select(
        "page_id", "row_no", F.transform(F.regexp_extract_all("row", F.lit(cell_pattern), F.lit(0)), strip).alias("cells")
    )


def table_sum(pages: DataFrame, html: str, width: int = 4, column: int = 4) -> DataFrame:
    """Per page the sum of one column over the rows of its first table that have `width` cells."""
    first = F.regexp_extract(html, r"(?s)<table.*?</table>", 0)
    rows = html_rows(pages.withColumn("_t", first), "_t", r"(?s)<tr.*?</tr>", r"(?s)<td.*?</td>")
    value = F.replace(F.element_at("cells", column), F.lit(","), F.lit("")).cast("long")
    return rows.filter(F.size("cells") == width).groupBy("page_id").agg(F.sum(value).alias("total"))


def bindings(spark_json: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """Query-result JSON (results.bindings) to rows of text values."""
    inner = ", ".join(f"{f}: struct<value: string>" for f in fields)
    parsed = F.from_json(text, f"results struct<bindings: array<struct<{inner}>>>")
    return spark_json.select(F.explode(parsed["results"]["bindings"]).alias("b")).select(
        *[F.col(f"b.{f}.value").alias(f) for f in fields]
    )


def values_of_year(rows: DataFrame, year: str) -> DataFrame:
    return rows.filter(F.col("time").startswith(year)).select("code", F.col("pop").cast("double").cast("long").alias("population"))


def labels_by_language(rows: DataFrame, codes: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """code with one label column per language, suffix removed, null where missing."""
    cut = F.col("label")
    for lang, suffix in suffixes.items():
        ends = (F.col("lang") == lang) & F.col("label").endswith(suffix)
        cut = F.when(ends, F.left("label", F.length("label") - len(suffix))).otherwise(cut)
    wide = rows.withColumn("label", cut).groupBy("code").pivot("lang", list(suffixes)).agg(F.min("label"))
    return codes.select("code").distinct().join(wide, "code", "left")


def bulletins(spark: SparkSession, path: str, schema: str, manifest: DataFrame) -> DataFrame:
    """Nested bulletin JSON joined to its manifest; bulletins without one keep null columns."""
    return spark.read.schema(schema).json(path).join(manifest, "id", "left")


def file_hashes(spark: SparkSession, path: str, key_pattern: str = "([^/]+)$") -> DataFrame:
    """(key, length, sha256) of every file under a folder; the key is cut from its path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select(F.regexp_extract("path", key_pattern, 1).alias("key"), "length", F.sha2("content", 256).alias("sha256"))


def write_manifests(rows: DataFrame, chunk: str, order: str, line: str, path: str) -> DataFrame:
    """One text file per chunk of rows, its lines in order; returns (chunk, body) as written. A chunk is as large as its key makes it."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line])
    bodies = rows.groupBy(chunk).agg(F.array_join(lines, "\n").alias("value"))
    bodies.write.partitionBy(chunk).text(path)
    return bodies.select(chunk, F.concat("value", F.lit("\n")).alias("body"))


def held_against(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files with a verdict: ok, changed (another hash is listed), unlisted; listed files that are absent are missing.

    files: key, length, sha256; listed: key, listed.
    """
    both = files.join(listed, "key", "full")
    return both.withColumn(
        "verdict",
        F.when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "unlisted")
        .when(F.col("sha256") != F.col("listed"), "changed").otherwise("ok"),
    )
