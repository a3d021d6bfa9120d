"""op7 and op9: DataFrame functions only, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.llm import secrets as S
from stormledger.llm import sharding as H
from stormledger.llm.registry import query, table

SHARDS = 40


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found_sql(pattern: str) -> str:
    """A list of {start, hit} per document: lengths of the pieces between matches, added up."""
    q = _quoted(pattern)
    return f"""list_transform(range(1, len(regexp_extract_all(t, {q})) + 1), lambda i: {{
        'start': list_sum(list_transform(regexp_split_to_array(t, {q})[:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(regexp_extract_all(t, {q})[:i - 1], lambda x: length(x))), 0),
        'hit': regexp_extract_all(t, {q})[i]}})"""


def _table_sql() -> str:
    return "[" + ", ".join(str(v) for v in S.XLOGX) + "]"


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT r, 'assign' AS kind, 0 AS k, unnest({_found_sql(S.ASSIGN)}) AS x FROM d
  UNION ALL SELECT r, 'access', 1, unnest({_found_sql(S.ACCESS)}) FROM d
  UNION ALL SELECT r, 'hex', 2, unnest({_found_sql(S.HEX)}) FROM d),
base AS (
  SELECT r, kind, k, x.start::BIGINT AS s, (x.start + length(x.hit))::BIGINT AS e FROM found
  WHERE kind <> 'assign' OR length(regexp_extract(x.hit, {_quoted(S.ASSIGN)}, 2)) >= {S.LEAST_ASSIGNED}),
cand AS (
  SELECT r, x.start::BIGINT AS s, x.hit AS hit FROM (SELECT r, unnest({_found_sql(S.CANDIDATE)}) AS x FROM d)
  WHERE regexp_matches(x.hit, '[0-9]') AND regexp_matches(x.hit, '[A-Za-z]') AND NOT regexp_matches(x.hit, {_quoted(S.ALLOWED)})),
clear AS (
  SELECT * FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.r = c.r AND b.s < c.s + length(c.hit) AND c.s < b.e)),
windows AS (
  SELECT r, s, i, CASE WHEN regexp_matches(hit, '^[0-9a-fA-F]+$') THEN {S.most_sum(S.BITS['hex'])} ELSE {S.most_sum(S.BITS['other'])} END AS most,
         string_split(substr(hit, i, {S.WINDOW}), '') AS w
  FROM (SELECT *, unnest(range(1, length(hit) - {S.WINDOW} + 2)) AS i FROM clear)),
hot AS (
  SELECT r, s + min(i) - 1 AS b, s + max(i) - 1 + {S.WINDOW} AS e FROM windows
  WHERE list_sum(list_transform(list_distinct(w), lambda c: {_table_sql()}[len(list_filter(w, lambda y: y = c)) + 1])) <= most
  GROUP BY r, s),
spans AS (
  SELECT r, k, s, e, kind || ':' || s || ':' || e AS said FROM base
  UNION ALL SELECT r, 3, b, e, 'entropy:' || b || ':' || e FROM hot),
per AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
         count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE k = 3) AS n_entropy,
         string_agg(said, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(said, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""


@query("op7_secrets", OP7_SQL)
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind_no"] == S.KINDS.index(kind))).cast("long")

    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in S.KINDS],
        F.sha2(S.span_text(F.col("base_spans")), 256).alias("base_sha256"), S.span_text(F.col("secret_spans")).alias("spans"),
    )


def _rounds_sql(source: str, target: str, x: str) -> str:
    """CTEs that send column x of source through the permutation, into `target`."""
    out = [f"{target}_0 AS (SELECT *, {x} // b AS l, {x} % b AS r FROM {source}, dom)"]
    for k in range(H.ROUNDS):
        v, side = ("r", "a") if k % 2 == 0 else ("l", "b")
        t = f"(({v} * {H.MULTIPLIERS[k]} + {H.INCREMENTS[k]}) % {H.PRIME})"
        moved = f"({'l' if k % 2 == 0 else 'r'} + ({t} * {t} + {v}) % {H.PRIME}) % {side}"
        parts = (f"{moved} AS l, r", f"l, {moved} AS r")[k % 2]
        out.append(f"{target}_{k + 1} AS (SELECT * EXCLUDE (l, r), {parts} FROM {target}_{k})")
    out.append(f"{target} AS (SELECT * EXCLUDE (l, r, n, a, b), l * b + r AS y FROM {target}_{H.ROUNDS})")
    return ",\n".join(out)


# CRC32 by its table, which eight shifts of each byte value give; a fold over the bytes of a text.
CRC_SQL = """
bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    fold = f"list_reduce({octets}, lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295::BIGINT)"
    return f"xor({fold}, 4294967295)"


# Walks are followed through the images of the numbers outside [0, N), of which there are few.
OP9_SQL = f"""
WITH RECURSIVE
count AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS root FROM documents),
side AS (SELECT n, unnest(range(root, least(2 * root, root + {H.SEARCHED - 1}) + 1)) AS a FROM count),
dom AS (SELECT n, a, (n + a - 1) // a AS b FROM side ORDER BY a * ((n + a - 1) // a), a LIMIT 1),
{CRC_SQL.strip()},
sized AS (
  SELECT doc_id, octet_length(encode(t))::BIGINT + 16 AS size, {crc_sql("t")} AS text_crc32
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), crc_table),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM sized),
{_rounds_sql("numbered", "once", "x")},
outside AS (SELECT unnest(range(n, a * b)) AS o FROM dom),
{_rounds_sql("outside", "onward", "o")},
walk AS (
  SELECT doc_id, size, text_crc32, y FROM once
  UNION ALL
  SELECT w.doc_id, w.size, w.text_crc32, o.y FROM walk w JOIN onward o ON w.y = o.o)
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % {SHARDS})::INT AS shard, y // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM walk, dom WHERE y < n
"""


@query("op9_shards", OP9_SQL)
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    placed = H.shard_rows(sized, ["doc_id", "size", "text_crc32"], SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
