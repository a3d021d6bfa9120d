"""op1, op5 and op10: documents judged, freed of repeated passages, and grouped by likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.llm import quality as Q
from stormledger.llm import spans as S
from stormledger.llm.quality import clean_lines
from stormledger.llm.registry import query, table
from stormledger.llm.simhash import near_groups
from stormledger.llm.spans import remove_repeats


_WORDS = r"'[^\x20\x09-\x0D]+'"


def _share(condition: str, percent: int) -> str:
    return f"100 * len(list_filter(w, lambda x: {condition})) >= {percent} * n"


def _pattern(compiled) -> str:
    return "'" + compiled.pattern.replace("'", "''") + "'"


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
worded AS (SELECT *, regexp_extract_all(line, {_WORDS}) AS w, len(regexp_extract_all(line, {_WORDS})) AS n FROM lines),
judged AS (
  SELECT *, CASE
    WHEN n >= {Q.LEAST_WORDS} AND {_share(f"regexp_matches(x, {_pattern(Q.SYMBOL_WORD)})", Q.SYMBOL_PCT)} THEN 'symbols'
    WHEN n >= {Q.LEAST_WORDS} AND {_share(f"regexp_full_match(x, {_pattern(Q.SEPARATOR)})", Q.SEPARATOR_PCT)}
      AND len(list_filter(w, lambda x: regexp_full_match(x, {_pattern(Q.SEPARATOR)}))) >= {Q.LEAST_SEPARATORS} THEN 'navigation'
    WHEN n >= {Q.LEAST_WORDS} AND {_share("suffix(x, '!')", Q.SHOUT_PCT)} THEN 'shouting'
    WHEN n >= {2 * Q.LEAST_WORDS} AND 100 * len(list_filter(range(1, n), lambda k: w[k] = w[k + 1])) >= {Q.STUTTER_PCT} * n THEN 'stutter'
    WHEN n >= {2 * Q.LEAST_WORDS}
      AND 2 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{Ll}}') AND NOT regexp_matches(x, '[\\p{{Lu}}\\p{{Lt}}]'))) < n
      AND 100 * len(regexp_extract_all(line, '\\p{{Lu}}')) >= {Q.CAPITAL_PCT} * greatest(1, len(regexp_extract_all(line, '\\p{{Lu}}|\\p{{Ll}}'))) THEN 'shouting'
    WHEN n BETWEEN 1 AND {Q.BOILERPLATE_WORDS} AND regexp_matches(lower(line), {_pattern(Q.BOILERPLATE)}) THEN 'boilerplate'
    WHEN n > {Q.LONG_LINE} AND NOT regexp_matches(line, {_pattern(Q.MARKS)}) THEN 'punctuation' END AS rule
  FROM worded),
by_line AS (
  SELECT r, sum(n) AS n_words, sum(list_sum(list_transform(w, lambda x: length(x)))) AS word_chars,
         count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(rule) AS n_failed_lines,
         sum(n) FILTER (rule IS NOT NULL) AS lost_words, list_distinct(list(rule) FILTER (rule IS NOT NULL)) AS rules,
         string_agg(line, chr(10) ORDER BY i) FILTER (rule IS NULL) AS left_text
  FROM judged GROUP BY r),
word AS (SELECT r, unnest(regexp_extract_all(text, {_WORDS})) AS word, unnest(range(len(regexp_extract_all(text, {_WORDS})))) AS i FROM d),
eights AS (
  SELECT r, i, string_agg(word, ' ') OVER eight AS s, count(*) OVER eight AS n FROM word
  WINDOW eight AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {Q.WINDOW - 1} FOLLOWING)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS times FROM eights WHERE n = {Q.WINDOW}) WHERE times > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range({Q.WINDOW}) k(k) GROUP BY r),
counted AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^{Q.SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_failed_lines, 0) AS n_failed_lines,
         coalesce(lost_words, 0)::BIGINT AS lost_words,
         array_to_string(list_filter([{", ".join(f"'{x}'" for x in Q.RULES)}], lambda x: list_contains(coalesce(rules, []), x)), ',') AS failed_rules,
         md5(CASE WHEN coalesce(n_failed_lines, 0) = 0 THEN coalesce(text, '') ELSE coalesce(left_text, '') END) AS clean_md5
  FROM d LEFT JOIN by_line USING (r) LEFT JOIN covered USING (r))
SELECT *, base_failed = false AND 100 * lost_words <= {Q.MAX_LOST_PCT} * n_words AS kept
FROM (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED_PCT} * n_words AS base_failed FROM counted)
"""


@query("op1_quality", OP1_SQL)
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_failed_lines", "lost_words", "failed_rules", F.md5(F.coalesce("clean_text", F.lit(""))).alias("clean_md5"),
    )


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", slim=True)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, {_pattern(S.SENTENCE)}) AS p FROM documents),
pieces AS (SELECT r, doc_id, unnest(p) AS s, unnest(range(len(p))) AS k FROM d),
said AS (
  SELECT r, doc_id, k, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM pieces),
numbered AS (
  SELECT r, doc_id, k, array_to_string(w, ' ') AS said, len(w) AS n, row_number() OVER o AS j, sum(len(w)) OVER o AS total
  FROM said WHERE len(w) > 0 WINDOW o AS (PARTITION BY r ORDER BY k)),
texts AS (SELECT r, list(said ORDER BY j) AS said FROM numbered GROUP BY r),
runs AS (
  SELECT a.r, a.doc_id, a.j, a.k AS first, min(b.j) AS last_j, min(b.k) AS last FROM numbered a JOIN numbered b
    ON b.r = a.r AND b.j >= a.j + {S.RUN_SENTENCES - 1} AND b.total - a.total + a.n >= {S.RUN_WORDS} GROUP BY ALL),
ranked AS (
  SELECT r, first, last, row_number() OVER (PARTITION BY array_to_string(said[j:last_j], ' ') ORDER BY doc_id NULLS FIRST, first) AS no
  FROM runs JOIN texts USING (r)),
gone AS (SELECT DISTINCT r, unnest(range(first, last + 1)) AS k FROM ranked WHERE no > 1),
left_over AS (
  SELECT r, count(g.k) AS removed, coalesce(string_agg(s, '' ORDER BY p.k) FILTER (g.k IS NULL), '') AS kept
  FROM pieces p LEFT JOIN gone g USING (r, k) GROUP BY r)
SELECT doc_id, CASE WHEN coalesce(removed, 0) > 0 THEN kept ELSE text END AS text, coalesce(removed, 0) AS removed_sentences
FROM d LEFT JOIN left_over USING (r)
"""


@query("op5_spans", OP5_SQL)
def op5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
