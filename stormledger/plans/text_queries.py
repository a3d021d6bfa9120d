"""Template, message, label and fact queries on whole documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormledger.functions import labels as L
from stormledger.functions import text as X
from stormledger.operators import facts as FX
from stormledger.operators import impact as M
from stormledger.operators import risk as R
from stormledger.operators import timeseries as TS
from stormledger.plans import inputs as I
from stormledger.plans.hazard_queries import hazard_cells
from stormledger.plans.inputs import CTE, r_sql, with_ctes
from stormledger.plans.registry import query
from stormledger.plans.risk_queries import infra, infra_status, medians, zone_scores, zone_sums
from stormledger.session import materialise

# Templates: documents with some words turned into placeholders.
_SWAPS = [
    (" of ", " {{isolated_count}} "), (" de ", " {{ isolated_count }} "), (" the ", " {{cut_count}} "),
    (" la ", " {{cut_count}} "), (". Th", ". {{top_driver}} Th"), (" und ", " {{peak_wind_ms}} km/h "), (" and ", " {{lead_hours}} hours "),
]
_T = "text"
for _a, _b in _SWAPS:
    _T = f"replace({_T}, '{_a}', '{_b}')"
CTE["templates"] = (f"SELECT doc_id, lang, {_T} AS template, doc_id % 12 AS n1, doc_id % 3 AS n2, doc_id % 70 AS wind FROM documents", [])
_P = r"\{\{\s*([a-z0-9_]+)\s*\}\}"


def templates(spark, sf):
    t = F.col("text")
    for a, b in _SWAPS:
        t = F.replace(t, F.lit(a), F.lit(b))
    d = F.col("doc_id")
    return I.spread(I.table(spark, sf, "documents")).select(
        "doc_id", "lang", t.alias("template"), (d % 12).alias("n1"), (d % 3).alias("n2"), (d % 70).alias("wind")
    )


@query(
    "placeholders",
    with_ctes("templates")
    + f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(template, '{_P}', 1))), ',') AS keys,
        array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(template, '{_P}', 1)), lambda k: k NOT IN ('isolated_count', 'cut_count', 'top_driver'))), ',') AS unknown,
        array_to_string(list_filter(['cut_count', 'isolated_count'], lambda k: NOT list_contains(regexp_extract_all(template, '{_P}', 1), k)), ',') AS removed FROM templates""",
)
def placeholders(spark, sf):
    t = F.col("template")
    offered = F.array(F.lit("isolated_count"), F.lit("cut_count"), F.lit("top_driver"))
    required = F.array(F.lit("isolated_count"), F.lit("cut_count"))
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return templates(spark, sf).select(
        "doc_id", join(X.placeholder_keys(t)).alias("keys"), join(X.unknown_keys(t, offered)).alias("unknown"),
        join(X.removed_keys(t, required)).alias("removed"),
    )


_WORDS = "[" + ",".join(f"'{w}'" for w in X.NUMBER_WORDS["en"]) + "]"
_BARE = f"regexp_replace(template, '{_P}', ' ', 'g')"
CTE["numbers"] = (
    f"""SELECT doc_id, len(regexp_extract_all({_BARE}, '\\p{{Nd}}'))::INTEGER AS digits,
          CASE WHEN lang = 'en' THEN len(list_filter(regexp_extract_all({_BARE}, '[\\p{{L}}\\p{{Nd}}_]+'), lambda w: list_contains({_WORDS}, lower(w)))) ELSE 0 END::INTEGER AS words FROM templates""",
    ["templates"],
)


def _numbers(spark, sf):
    t = templates(spark, sf)
    return t.select(
        "doc_id", F.size(X.digits(F.col("template"))).alias("digits"),
        F.size(X.number_words(F.col("template"), F.col("lang"))).alias("words"),
    )


@query("number_problems", with_ctes("numbers") + "SELECT * FROM numbers")
def number_problems(spark, sf):
    return _numbers(spark, sf)


CTE["sentences"] = (
    r"""SELECT doc_id, n1, n2, unnest(string_split(regexp_replace(template, '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM templates""",
    ["templates"],
)
CTE["doubled"] = (
    "SELECT doc_id, count(*) AS n FROM sentences WHERE n1 = n2 AND contains(sentence, '{{cut_count}}') AND regexp_matches(sentence, '\\{\\{ ?isolated_count ?\\}\\}') GROUP BY 1",
    ["sentences"],
)


def _duplicates(spark, sf):
    t = templates(spark, sf)
    values = F.create_map(F.lit("isolated_count"), F.col("n1"), F.lit("cut_count"), F.col("n2"))
    return t.select("doc_id", F.explode(X.sentences(F.col("template"))).alias("s"), values.alias("v")).select(
        "doc_id", F.size(X.duplicate_counts(F.col("s"), F.col("v"))).alias("n")
    ).groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 0")


@query("duplicate_counts", with_ctes("doubled") + "SELECT doc_id, n FROM doubled")
def duplicate_counts(spark, sf):
    return _duplicates(spark, sf)


@query(
    "draft_verdicts",
    with_ctes("numbers", "doubled")
    + """SELECT n.doc_id, CASE WHEN digits + words > 0 THEN 'number_check_failed' WHEN coalesce(d.n, 0) > 0 THEN 'invalid_response' ELSE 'pass' END AS verdict
        FROM numbers n LEFT JOIN doubled d ON d.doc_id = n.doc_id""",
)
def draft_verdicts(spark, sf):
    both = _numbers(spark, sf).join(_duplicates(spark, sf), "doc_id", "left")
    return both.select("doc_id", X.verdict(F.col("digits") + F.col("words"), F.coalesce("n", F.lit(0))).alias("verdict"))


_SHOWN = {
    "isolated_count": "n1::VARCHAR", "cut_count": "n2::VARCHAR", "lead_hours": "CASE WHEN n1 = 1 THEN '1 hour' ELSE n1 || ' hours' END",
    "peak_wind_ms": "(floor(wind * 3.6e0 / 5 + 0.5e0) * 5)::BIGINT || ' km/h'", "top_driver": "CASE WHEN n2 = 0 THEN 'wind' ELSE 'storm surge' END",
}
_F = "template"
_F = f"regexp_replace({_F}, '\\{{\\{{lead_hours\\}}\\}} hours([^\\p{{L}}])', '{{{{lead_hours}}}}\\1', 'g')"
_F = f"replace({_F}, '{{{{peak_wind_ms}}}} km/h ', '{{{{peak_wind_ms}}}} ')"
_F = f"replace({_F}, '. {{{{top_driver}}}}', '. ' || CASE WHEN n2 = 0 THEN 'Wind' ELSE 'Storm surge' END)"
for _k, _v in _SHOWN.items():
    _F = f"replace({_F}, '{{{{{_k}}}}}', {_v})"
_F = f"replace({_F}, '{{{{ isolated_count }}}}', n1::VARCHAR)"


@query("fill_template", with_ctes("templates") + f"SELECT doc_id, length({_F}) AS n_chars, md5({_F}) AS digest FROM templates")
def fill_template(spark, sf):
    c = F.col
    count = lambda v: X.format_number(c(v), F.lit(None).cast("string"), "en")
    shown = F.create_map(
        F.lit("isolated_count"), count("n1"), F.lit("cut_count"), count("n2"),
        F.lit("lead_hours"), X.format_number(c("n1"), F.lit("h"), "en"),
        F.lit("peak_wind_ms"), X.format_number(c("wind"), F.lit("m/s"), "en"),
        F.lit("top_driver"), F.when(c("n2") == 0, F.lit("wind")).otherwise(F.lit("storm surge")),
    )
    units = F.create_map(F.lit("lead_hours"), F.lit("h"), F.lit("peak_wind_ms"), F.lit("m/s"))
    out = X.fill(c("template"), shown, units)
    return templates(spark, sf).select("doc_id", out.alias("t")).select(
        "doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest")
    )


_LIMIT = 500


@query(
    "split_text",
    f"""WITH p AS (SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda s: {{'parts': []::VARCHAR[], 'cur': s}}),
          lambda a, y: {{'parts': list_concat(list_concat(list_concat(a.parts, CASE WHEN greatest(length(y.cur) - 1, 0) // {_LIMIT} > 0 AND a.cur <> '' THEN [a.cur] ELSE []::VARCHAR[] END),
              list_transform(range(greatest(length(y.cur) - 1, 0) // {_LIMIT}), lambda i: substr(y.cur, i * {_LIMIT} + 1, {_LIMIT}))),
              CASE WHEN length(CASE WHEN greatest(length(y.cur) - 1, 0) // {_LIMIT} > 0 OR a.cur = '' THEN y.cur[greatest(length(y.cur) - 1, 0) // {_LIMIT} * {_LIMIT} + 1:] ELSE a.cur || chr(10) || y.cur END) > {_LIMIT}
                THEN [CASE WHEN greatest(length(y.cur) - 1, 0) // {_LIMIT} > 0 THEN '' ELSE a.cur END] ELSE []::VARCHAR[] END),
            'cur': CASE WHEN greatest(length(y.cur) - 1, 0) // {_LIMIT} > 0 OR a.cur = '' THEN y.cur[greatest(length(y.cur) - 1, 0) // {_LIMIT} * {_LIMIT} + 1:]
              WHEN length(a.cur || chr(10) || y.cur) > {_LIMIT} THEN y.cur ELSE a.cur || chr(10) || y.cur END}},
          {{'parts': []::VARCHAR[], 'cur': ''}}) AS r FROM documents),
        q AS (SELECT doc_id, CASE WHEN r.cur <> '' THEN list_append(r.parts, r.cur) ELSE r.parts END AS parts FROM p)
        SELECT doc_id, i::INTEGER AS part_no, length(parts[i])::INTEGER AS n_chars, md5(parts[i]) AS digest FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM q)""",
)
def split_text(spark, sf):
    d = I.spread(I.table(spark, sf, "documents"))
    return d.select("doc_id", F.posexplode(X.split_message(F.col("text"), _LIMIT)).alias("i", "part")).select(
        "doc_id", (F.col("i") + 1).alias("part_no"), F.length("part").alias("n_chars"), F.md5("part").alias("digest")
    )


@query(
    "mask_values",
    """SELECT c_custkey, CASE WHEN length(a) > 2 THEN substr(a, 1, 2) || repeat('*', greatest(length(a) - 2, 3)) ELSE substr(a, 1, 1) || '***' END || '@' || d AS email,
        CASE WHEN length(k) > 4 THEN repeat('*', greatest(length(k) - 4, 3)) || right(k, 4) ELSE '****' END AS chat,
        replace(replace(c_name, 'Customer', '***'), c_mktsegment, '***') AS scrubbed
       FROM (SELECT *, substr(lower(c_name), 1, (c_custkey % 12 + 1)::INTEGER) AS a, lower(c_mktsegment) || '.org' AS d, (c_custkey * 37)::VARCHAR AS k FROM customer)""",
)
def mask_values(spark, sf):
    k = F.col("c_custkey")
    local = F.substring(F.lower("c_name"), F.lit(1), (k % 12 + 1).cast("int"))
    return I.table(spark, sf, "customer").select(
        "c_custkey", X.mask_email(F.concat(local, F.lit("@"), F.lower("c_mktsegment"), F.lit(".org"))).alias("email"),
        X.mask_id((k * 37).cast("string")).alias("chat"),
        X.scrub(F.col("c_name"), F.array(F.lit("Customer"), F.lit(""), F.col("c_mktsegment"))).alias("scrubbed"),
    )


@query(
    "name_keys",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name_key FROM documents""",
)
def name_keys(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.coalesce(X.name_key(F.col("text")), F.lit("")).alias("name_key"))


@query(
    "loose_zone_pairs",
    with_ctes("fixes")
    + """, lim AS (SELECT min(step) AS lo, max(step) AS hi FROM fixes),
        items AS (SELECT c_custkey AS id, unnest([ 'Nation ' || c_nationkey || ':T-' || (c_custkey % 300), c_nationkey || ': T-' || (c_custkey % 90), 'nowhere:T-3', 'NATION-' || c_nationkey, ' ']) AS item FROM customer),
        s AS (SELECT id, trim(item) AS item, trim(string_split(trim(item), ':')[1]) AS block, trim(string_split(trim(item), ':')[2]) AS w, contains(item, ':') AS sep FROM items WHERE trim(item) <> ''),
        z AS (SELECT s.*, n_nationkey::BIGINT AS code, CASE WHEN regexp_matches(coalesce(w, ''), '^T-[0-9]+$') AND (substr(w, 3)::INT % 3 = 0) AND substr(w, 3)::INT <= (hi - lo) * 3 THEN hi - substr(w, 3)::INT // 3 END AS step
          FROM s CROSS JOIN lim LEFT JOIN nation ON lower(replace(replace(replace(block, ' ', ''), '-', ''), '_', '')) IN (replace(lower(n_name), '_', ''), n_nationkey::VARCHAR)),
        e AS (SELECT *, CASE WHEN NOT sep THEN 'expected <zone>:<time>' WHEN code IS NULL THEN 'unknown zone' WHEN step IS NULL THEN 'not a step' END AS error FROM z)
        SELECT DISTINCT id, CASE WHEN error IS NULL THEN code END AS code, CASE WHEN error IS NULL THEN step END AS step, CASE WHEN error IS NOT NULL THEN item END AS item, error FROM e""",
)
def loose_zone_pairs(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    text = F.concat_ws(
        ",", F.concat(F.lit("Nation "), n, F.lit(":T-"), (k % 300).cast("string")),
        F.concat(n, F.lit(": T-"), (k % 90).cast("string")), F.lit("nowhere:T-3"), F.concat(F.lit("NATION-"), n), F.lit(" "),
    )
    nation = I.table(spark, sf, "nation")
    code = F.col("n_nationkey").cast("long")
    zones = nation.select(
        F.explode(F.array(L.loose_name(F.col("n_name")), code.cast("string"))).alias("alias"), code.alias("code")
    )
    span = I.fixes(spark, sf).agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    steps = span.select("hi", F.explode(F.sequence("lo", "hi")).alias("step")).select(
        F.concat(F.lit("T-"), ((F.col("hi") - F.col("step")) * 3).cast("string")).alias("label"), "step"
    )
    return FX.parse_pairs(I.table(spark, sf, "customer").select(k.alias("id"), text.alias("t")), "t", zones, steps)


@query(
    "approvers",
    r"""SELECT c_custkey, regexp_matches(a, '^\S.*?\s+\((?:BDO|SDO|ADM \(Disaster Management\)|District Magistrate|Other: *[^()]*?\S[^()]*?)\)$') AS ok FROM (
        SELECT c_custkey, c_name || (CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' ' END) || '(' || (['BDO', 'Other: x', 'Other: ', 'ADM (Disaster Management)', 'Clerk', 'SDO'])[c_custkey % 6 + 1] || ')' AS a FROM customer)""",
)
def approvers(spark, sf):
    k = F.col("c_custkey")
    roles = F.array(*[F.lit(r) for r in ["BDO", "Other: x", "Other: ", "ADM (Disaster Management)", "Clerk", "SDO"]])
    role = F.element_at(roles, (k % 6 + 1).cast("int"))
    text = F.concat("c_name", F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(" ")), F.lit("("), role, F.lit(")"))
    return I.table(spark, sf, "customer").select("c_custkey", X.approver_ok(text).alias("ok"))


@query(
    "corridors",
    """SELECT doc_id, contains(lower(text), 'sundarban') OR doc_id % 37 = 0 OR contains(lower(text), 'crossed') AS holds FROM documents""",
)
def corridors(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", X.corridor_holds(F.col("text"), F.col("doc_id") % 37, F.col("text")).alias("holds")
    )


@query(
    "stale_citations",
    """WITH cur AS (SELECT p_brand AS key, p_partkey % 50 AS g, min(p_name) AS text FROM part WHERE p_size > 5 GROUP BY 1, 2),
       old AS (SELECT p_brand AS key, p_partkey % 50 AS g, min(p_name) AS text FROM part GROUP BY 1, 2)
       SELECT o.g, o.key, CASE WHEN c.key IS NULL THEN 'missing_key' ELSE 'changed_text' END AS reason FROM old o LEFT JOIN cur c ON c.key = o.key AND c.g = o.g
       WHERE c.key IS NULL OR c.text <> o.text""",
)
def stale_citations(spark, sf):
    p = I.table(spark, sf, "part").select(F.col("p_brand").alias("key"), (F.col("p_partkey") % 50).alias("g"), "p_name", "p_size")
    old = p.groupBy("key", "g").agg(F.min("p_name").alias("text"))
    cur = p.filter("p_size > 5").groupBy("key", "g").agg(F.min("p_name").alias("str_value"))
    return FX.stale(old, cur, ["g"])


@query("repair_counts")
def repair_counts(spark, sf):
    """Count words of the documents turned into placeholders (checked by unit tests)."""
    d = I.spread(I.table(spark, sf, "documents"))
    keys = F.create_map(F.lit(2), F.lit("isolated_count"), F.lit(3), F.lit("cut_count"), F.lit(8), F.lit("standin_count"))
    fixed = X.repair_counts(F.col("text"), "en", keys)
    return d.select("doc_id", F.length(fixed).alias("n_chars"), F.size(X.placeholder_keys(fixed)).alias("keys"))


# --- Tags, kinds, formats ------------------------------------------------------------------------

_NAMES = ["cyclone hall", "Rural Hospital", "forest office", "flood centre", "city eye clinic", "Medical College clinic"]
CTE["tagged"] = (
    """SELECT p_partkey AS id, (['hospital', 'clinic', 'school', 'townhall', 'pub', 'college'])[p_partkey % 6 + 1] AS amenity,
         (['public', 'school', 'flood_wall', 'yes'])[p_size % 4 + 1] AS building, (['government', 'company'])[p_partkey % 2 + 1] AS office,
         (['primary', 'tertiary_link', 'track', 'unclassified', 'trunk', 'motorway_junction', 'primary_road'])[p_partkey % 7 + 1] AS highway, CASE WHEN p_partkey % 9 = 0 THEN 'ferry' END AS route,
         CASE WHEN p_size % 7 = 0 THEN 'assembly_point' END AS emergency,
         CASE WHEN p_partkey % 8 < 6 THEN (['cyclone hall', 'Rural Hospital', 'forest office', 'flood centre', 'city eye clinic', 'Medical College clinic'])[p_partkey % 8 + 1] ELSE p_name END AS name FROM part""",
    [],
)


def tagged(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    tags = F.create_map(
        F.lit("amenity"), pick(["hospital", "clinic", "school", "townhall", "pub", "college"], k % 6),
        F.lit("building"), pick(["public", "school", "flood_wall", "yes"], s % 4),
        F.lit("office"), pick(["government", "company"], k % 2),
        F.lit("highway"), pick(["primary", "tertiary_link", "track", "unclassified", "trunk", "motorway_junction", "primary_road"], k % 7),
        F.lit("route"), F.when(k % 9 == 0, F.lit("ferry")), F.lit("emergency"), F.when(s % 7 == 0, F.lit("assembly_point")),
        F.lit("name"), F.when(k % 8 < 6, pick(_NAMES, F.least(k % 8, F.lit(5)))).otherwise(F.col("p_name")),
    )
    return I.table(spark, sf, "part").select(k.alias("id"), tags.alias("tags"))


_SHELTER = """CASE WHEN contains(building, 'flood') OR regexp_matches(lower(name), 'cyclone|flood shelter|flood cent(re|er)') THEN 'cyclone_shelter'
  WHEN emergency = 'assembly_point' THEN 'assembly_point' WHEN amenity IN ('school', 'college') OR building = 'school' THEN 'school_proxy'
  WHEN amenity = 'townhall' THEN 'community_proxy'
  WHEN (office = 'government' OR building = 'public') AND NOT regexp_matches(lower(name), '\\b(forest|range|beat)\\s+office') THEN 'public_building_proxy' END"""


@query(
    "classify_tags",
    with_ctes("tagged")
    + f"""SELECT id, {_SHELTER} AS shelter_kind,
        CASE WHEN amenity IN ('hospital', 'clinic') THEN CASE WHEN amenity = 'hospital' OR regexp_matches(lower(name), 'rural hospital') THEN 'hospital' ELSE 'health_centre' END END AS level,
        coalesce(route = 'ferry', false) AS ferry, coalesce(route = 'ferry', false) OR highway IN ('primary', 'tertiary_link', 'unclassified', 'trunk') AS road FROM tagged""",
)
def classify_tags(spark, sf):
    t = F.col("tags")
    return tagged(spark, sf).select(
        "id", L.shelter_kind(t).alias("shelter_kind"), L.facility_level(t).alias("level"), L.is_ferry(t).alias("ferry"), L.is_road(t).alias("road")
    )


@query(
    "keep_exclude",
    with_ctes("tagged")
    + r"""SELECT id, regexp_matches(lower(name), 'rural hospital|medical college') OR NOT regexp_matches(lower(name), 'nursing\s*home|\bclinic\b|\beye\b') AS counts FROM tagged""",
)
def keep_exclude(spark, sf):
    return tagged(spark, sf).select("id", L.counts_for_access(F.col("tags")["name"]).alias("counts"))


_KINDS5 = "(['road', 'power_line', 'substation', 'hospital', 'shelter'])[(id % 5)::INTEGER + 1]"


@query(
    "kind_labels",
    with_ctes("tagged")
    + f""", k AS (SELECT *, {_KINDS5} AS t, coalesce(route = 'ferry', false) AS f, {_SHELTER} AS sk, amenity = 'hospital' OR regexp_matches(lower(name), 'rural hospital') AS top FROM tagged),
        l AS (SELECT *, CASE t WHEN 'road' THEN CASE WHEN f THEN 'Ferry route' WHEN suffix(highway, '_link') THEN 'Slip road' WHEN highway = 'primary' THEN 'Primary road'
            WHEN highway = 'unclassified' THEN 'Minor road' WHEN highway = 'trunk' THEN 'Trunk road' ELSE 'Road' END WHEN 'power_line' THEN 'Power line' WHEN 'substation' THEN 'Substation'
            WHEN 'hospital' THEN CASE WHEN top AND amenity IN ('hospital', 'clinic') THEN 'Hospital' ELSE 'Health centre' END
            ELSE CASE sk WHEN 'cyclone_shelter' THEN 'Cyclone shelter' WHEN 'assembly_point' THEN 'Assembly point' WHEN 'school_proxy' THEN 'School or college'
              WHEN 'community_proxy' THEN 'Community centre' WHEN 'public_building_proxy' THEN 'Public building' ELSE 'Shelter' END END AS label FROM k)
        SELECT id, label, CASE t WHEN 'power_line' THEN 'Power line segment' WHEN 'road' THEN CASE WHEN f THEN 'Ferry route segment' ELSE 'Road segment' END ELSE 'Unnamed ' || lower(label) END
          || CASE WHEN id % 4 > 0 THEN ' · ' || name ELSE '' END AS unnamed FROM l""",
)
def kind_labels(spark, sf):
    t = F.col("tags")
    kinds = F.array(*[F.lit(x) for x in ["road", "power_line", "substation", "hospital", "shelter"]])
    kind = F.element_at(kinds, (F.col("id") % 5 + 1).cast("int"))
    label = L.kind_label(kind, L.is_ferry(t), t["highway"], L.facility_level(t), L.shelter_kind(t))
    return tagged(spark, sf).select(
        "id", label.alias("label"), L.unnamed_label(kind, L.is_ferry(t), label, F.when(F.col("id") % 4 > 0, t["name"])).alias("unnamed")
    )


def _groups(n: str) -> str:
    return (
        f"CASE WHEN length(({n})::VARCHAR) <= 3 THEN ({n})::VARCHAR ELSE ltrim(reverse(regexp_replace(reverse(left(({n})::VARCHAR, length(({n})::VARCHAR) - 3)), '([0-9]{{2}})', '\\1,', 'g')), ',')"
        f" || ',' || right(({n})::VARCHAR, 3) END"
    )


_H = "floor(o_totalprice * 1000 / 1e5 + 0.5e0)::BIGINT"
_K = "(floor(o_totalprice / 1000e0 + 0.5e0) * 1000)::BIGINT"
_LK = "floor(o_totalprice / 10000e0 + 0.5e0)::BIGINT"


@query(
    "number_formats",
    f"""SELECT o_orderkey, '₹' || {_groups(f'{_H} // 100')} || '.' || lpad(({_H} % 100)::VARCHAR, 2, '0') || ' crore' AS crore,
        CASE WHEN o_totalprice <= 0 THEN '0' WHEN o_totalprice < 1000 THEN '<1,000' WHEN {_K} < 100000 THEN '~' || {_groups(_K)} ELSE '~' || ({_LK} // 10) || '.' || ({_LK} % 10) || ' lakh' END AS people,
        CASE WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' h ' || lpad((m % 60)::VARCHAR, 2, '0') || ' min' END AS duration,
        CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5) || ' h before landfall' ELSE 'at landfall' END AS lead,
        ((o_orderkey % 7 + 1) * 11) || ' kV / low' AS voltage
       FROM (SELECT *, floor(o_totalprice / 60e0 + 0.5e0)::BIGINT AS m FROM orders)""",
)
def number_formats(spark, sf):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    volts = F.concat(((k % 7 + 1) * 11000).cast("string"), F.lit(";low"))
    return I.table(spark, sf, "orders").select(
        "o_orderkey", L.crore(p * 1000).alias("crore"), L.people(p).alias("people"), L.duration(p).alias("duration"),
        L.before_landfall(k % 5).alias("lead"), L.voltage(volts).alias("voltage"),
    )


@query(
    "alert_bands",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s >= 0.6e0 THEN 'Extreme' WHEN s >= 0.4e0 THEN 'Severe' WHEN s >= 0.25e0 THEN 'Moderate' ELSE 'Minor' END AS severity,
        CASE WHEN l_linenumber * 4 <= 12 THEN 'Immediate' ELSE 'Future' END AS urgency, CASE WHEN l_linenumber - 3 <= 0 THEN 'Observed' ELSE 'Likely' END AS certainty,
        (CASE WHEN s >= 0.75e0 THEN 3 WHEN s >= 0.5e0 THEN 2 WHEN s >= 0.25e0 THEN 1 ELSE 0 END)::INTEGER AS class FROM (SELECT *, l_quantity / 50e0 AS s FROM lineitem)""",
)
def alert_bands(spark, sf):
    s, n = F.col("l_quantity") / 50.0, F.col("l_linenumber")
    return I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", L.alert_severity(s).alias("severity"), L.alert_urgency(n * 4).alias("urgency"),
        L.alert_certainty(n - 3).alias("certainty"), L.risk_class(s).alias("class"),
    )


@query(
    "names_and_more",
    """WITH x AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
       SELECT c_nationkey, string_agg(c_name, ', ' ORDER BY c_name) FILTER (i <= 2) || CASE WHEN max(n) > 2 THEN ' and ' || (max(n) - 2) || ' more' ELSE '' END AS label FROM x GROUP BY 1""",
)
def names_and_more(spark, sf):
    return M.names_and_more(I.table(spark, sf, "customer"), ["c_nationkey"], "c_name")


# --- Facts ---------------------------------------------------------------------------------------

CTE["fact_rows"] = (
    f"""SELECT s.zone_id, s.event, s.step, s.zone_name, (l.hi - s.step) * 3 AS hours, {r_sql('s.score', 4)} AS score, {r_sql('a.score', 4)} AS score_24h,
          {r_sql('s.hazard', 4)} AS hazard, {r_sql('s.exposure', 4)} AS exposure, {r_sql('s.vulnerability', 4)} AS vulnerability, s.reach, s.top_driver,
          coalesce(i.isolated, 0) AS isolated, coalesce(a2.ahead, 0) - coalesce(i.isolated, 0) AS expected, coalesce(i.hospitals, 0) AS hospitals,
          coalesce(i.havens, 0) AS havens, coalesce(i.substations, 0) AS substations, floor(coalesce(i.cut_m, 0) / 1000e0 * 10e0 + 0.5e0) / 10e0 AS cut_km,
          {r_sql('coalesce(p.surge, 0e0)', 2)} AS peak_surge, floor(coalesce(p.wind, 0e0) + 0.5e0) AS peak_wind,
          CASE WHEN m.median_s < 'infinity'::DOUBLE THEN floor(m.median_s / 60 + 0.5e0) END AS median_min, coalesce(c.shelters, 0) AS shelters, coalesce(n.named, 0) AS named
        FROM scores s JOIN scores a ON a.zone_id = s.zone_id AND a.event = s.event AND a.step = s.step AND a.horizon_h = 24
        JOIN (SELECT event, max(step) AS hi FROM fixes GROUP BY 1) l ON l.event = s.event
        LEFT JOIN (SELECT zone_id, event, step, count_if(status = 'isolated')::BIGINT AS isolated, count_if(status = 'isolated' AND infra_type = 'hospital')::BIGINT AS hospitals,
            count_if(status = 'isolated' AND infra_type = 'shelter')::BIGINT AS havens, count_if(status = 'cut' AND infra_type = 'substation')::BIGINT AS substations,
            sum(CASE WHEN infra_type = 'road' AND status = 'cut' THEN length_m ELSE 0 END)::BIGINT AS cut_m FROM infra_hazard WHERE horizon_h = 0 GROUP BY 1, 2, 3) i
          ON i.zone_id = s.zone_id AND i.event = s.event AND i.step = s.step
        LEFT JOIN (SELECT zone_id, event, step, count_if(status = 'isolated')::BIGINT AS ahead FROM infra_hazard WHERE horizon_h = 24 GROUP BY 1, 2, 3) a2
          ON a2.zone_id = s.zone_id AND a2.event = s.event AND a2.step = s.step
        LEFT JOIN (SELECT o.zone_id, h.event, h.step, max(h.surge) AS surge, max(h.wind) AS wind FROM hazard h JOIN overlap o ON o.cell_id = h.cell_id WHERE o.area_m2 > 0 GROUP BY 1, 2, 3) p
          ON p.zone_id = s.zone_id AND p.event = s.event AND p.step = s.step
        LEFT JOIN access m ON m.zone_id = s.zone_id LEFT JOIN capacity c ON c.zone_id = s.zone_id
        LEFT JOIN (SELECT zone_id, count(DISTINCT name) AS named FROM infra WHERE infra_type = 'shelter' GROUP BY 1) n ON n.zone_id = s.zone_id
        WHERE s.horizon_h = 0""",
    ["scores", "hazard", "overlap"],
)
_KEYS = ["zone_id", "event", "step"]
_TEXTS = {
    "block_name": "zone_name", "timestep_utc": "strftime(TIMESTAMP '2024-01-01' + to_hours((step * 3)::INTEGER), '%d %b %Y, %H:%M')",
    "reach": "CASE reach WHEN 'direct' THEN 'direct hazard' ELSE 'cut off by the storm' END",
    "top_driver": "CASE top_driver WHEN 'surge' THEN 'storm surge' WHEN 'flood' THEN 'flood susceptibility' WHEN 'mapped_shelters' THEN 'few mapped shelters' ELSE replace(top_driver, '_', ' ') END",
}
_FIGURES = {
    "hours_to_landfall": "hours", "risk_score": "score", "risk_score_24h": "score_24h", "risk_hazard": "hazard", "risk_exposure": "exposure",
    "risk_vulnerability": "vulnerability", "hospital_median_min": "median_min", "peak_surge_m": "peak_surge", "peak_wind_ms": "peak_wind",
    "isolated_count": "isolated", "isolated_hospital_count": "hospitals", "isolated_shelter_count": "havens", "expected_isolated_count": "expected",
    "cut_road_km": "cut_km", "cut_substation_count": "substations", "standin_count": "shelters", "standin_named_count": "least(named, 10)",
}
_FACTS = ", ".join(
    [f"{{'key': '{k}', 'num_value': NULL::DOUBLE, 'str_value': {v}}}" for k, v in _TEXTS.items()]
    + [f"{{'key': '{k}', 'num_value': ({v})::DOUBLE, 'str_value': NULL}}" for k, v in _FIGURES.items()]
)
_TRIVIAL = " OR ".join(f"(f.key = '{k}' AND f.num_value < {v!r})" for k, v in X.TRIVIAL_BELOW.items())


@query(
    "zone_facts",
    with_ctes("fact_rows")
    + f"""SELECT zone_id, event, step, f.key, f.num_value, f.str_value,
          f.key NOT IN ({", ".join(f"'{k}'" for k in X.SCORE_KEYS)}) AND NOT coalesce({_TRIVIAL}, false) AS offered
        FROM (SELECT *, unnest([{_FACTS}]) AS f FROM fact_rows) WHERE f.num_value IS NOT NULL OR f.str_value IS NOT NULL""",
)
def zone_facts(spark, sf):
    """Every fact of every zone and step; `offered` tells those that may be used as placeholders."""
    sums, impacts = zone_sums(spark, sf)
    both = zone_scores(spark, sf, (sums, impacts))
    now = F.col("horizon_h") == 0
    at = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    counted = ["isolated", "isolated_hospitals", "isolated_shelters", "cut_m", "substations"]
    counts = impacts.groupBy(*_KEYS).agg(
        *[at(c, now).alias(c) for c in counted], (at("isolated", ~now) - at("isolated", now)).alias("expected")
    )
    peaks = sums.select(*_KEYS, "peak_surge", "peak_wind")
    havens = infra(spark, sf).filter("infra_type = 'shelter'").groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("shelters"), F.count_distinct("name").alias("named"))
    last = I.event_buckets(spark, sf).groupBy("event").agg(F.max("step").alias("hi"))
    wide = both.groupBy(*_KEYS, "zone_name").agg(
        F.max(F.when(F.col("horizon_h") == 24, F.col("score"))).alias("score_24h"),
        *[F.max(F.when(F.col("horizon_h") == 0, F.col(c))).alias(c) for c in ["score", "hazard", "exposure", "vulnerability", "reach", "top_driver"]],
    )
    rows = (
        wide.join(counts, _KEYS, "left").join(peaks, _KEYS, "left").join(havens, "zone_id", "left")
        .na.fill(0, [*counts.columns[3:], "peak_surge", "peak_wind", "shelters", "named"])
        .join(medians(spark, sf), "zone_id", "left").join(last, "event")
        .withColumn("hours", (F.col("hi") - F.col("step")) * 3)
        .withColumn("time", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("step") * 3).cast("int")))
    )
    facts = FX.zone_facts(rows, _KEYS)
    return facts.select(*_KEYS, "key", "num_value", "str_value", X.offered(F.col("key"), F.col("num_value")).alias("offered"))


@query(
    "facility_facts",
    with_ctes("infra_hazard")
    + """, e AS (SELECT DISTINCT zone_id, infra_id, name FROM infra_hazard WHERE horizon_h = 0 AND status = 'isolated'),
        n AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY name, infra_id) AS i FROM e)
        SELECT zone_id, 'isolated_' || i || '_name' AS key, name AS str_value FROM n UNION ALL SELECT zone_id, 'isolated_' || i || '_id', infra_id::VARCHAR FROM n""",
)
def facility_facts(spark, sf):
    """Facilities ever cut off, numbered by name within their zone."""
    now = TS.whole_event_max(hazard_cells(spark, sf), ["cell_id"], ["wind", "surge"]).withColumns(
        {"step": F.lit(0), "horizon_h": F.lit(0)}
    )
    iso = infra_status(spark, sf, now).filter("status = 'isolated'").select("zone_id", "infra_id", "name").withColumn("id", F.col("infra_id"))
    return FX.ordinal_facts(iso, ["zone_id"], "isolated", [F.col("name"), F.col("infra_id")], ["name", "id"])


@query(
    "suggestion_reasons",
    with_ctes("scores", "mid")
    + """, now AS (SELECT s.* FROM scores s JOIN mid m ON m.event = s.event AND m.step = s.step WHERE horizon_h = 24 AND score >= 0.25e0)
        SELECT zone_id, 0 AS ord, 'risk' AS kind, printf('risk %.2f', floor(score * 100e0 + 0.5e0) / 100e0) AS label, NULL::BIGINT AS infra_id FROM now
        UNION ALL SELECT DISTINCT zone_id, 1, 'expected_cut_off', name || ' expected to be cut off', infra_id FROM infra_hazard WHERE horizon_h = 24 AND status = 'isolated'""",
)
def suggestion_reasons(spark, sf):
    from stormledger.plans.risk_queries import _mid

    now = zone_scores(spark, sf).filter("horizon_h = 24").join(_mid(spark, sf), ["event", "step"])
    peak = TS.whole_event_max(hazard_cells(spark, sf), ["cell_id"], ["wind", "surge"]).withColumns({"step": F.lit(0), "horizon_h": F.lit(24)})
    cut = infra_status(spark, sf, peak).filter("status = 'isolated'").select("zone_id", F.col("name").alias("label"), "infra_id")
    return R.suggestion_reasons(now, cut)


@query(
    "named_stand_ins",
    with_ctes("infra")
    + """, n AS (SELECT DISTINCT zone_id, name FROM infra WHERE infra_type = 'shelter'), r AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY name) AS i FROM n)
        SELECT zone_id, name, i, count(*) OVER (PARTITION BY zone_id) AS total FROM r""",
)
def named_stand_ins(spark, sf):
    from stormledger.plans.risk_queries import infra

    return FX.named_stand_ins(infra(spark, sf).filter("infra_type = 'shelter'"), ["zone_id"])




@query(
    "fixed_action",
    """SELECT p_partkey, array_to_string(['a1', 'a2', 'a3', 'a4', 'a5'][:p_size % 6] || CASE WHEN p_partkey % 3 = 0 AND p_size % 6 < 5 THEN ['Find a safe building'] ELSE [] END, '|') AS actions,
         p_partkey % 3 = 0 AND p_size % 6 = 5 AS too_many FROM part""",
)
def fixed_action(spark, sf):
    """The action for zones without a shelter, appended where the list has room."""
    some = F.slice(F.array(*[F.lit(f"a{i}") for i in range(1, 6)]), F.lit(1), (F.col("p_size") % 6).cast("int"))
    action, standins = F.lit("Find a safe building"), F.col("p_partkey") % 3
    return I.table(spark, sf, "part").select(
        "p_partkey", F.array_join(X.add_action(some, standins, action), "|").alias("actions"), X.too_many_actions(some, standins, action).alias("too_many"),
    )
