"""The same results as SQL for DuckDB, stated independently of the Spark code.

Single precision on both sides (see ``stable`` in queries).
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong name, direction or weight in the library shows.
FEATURES = [
    "ratioMax", "ratioMaxX", "yMax", "yStdRate", "yMeanRate", "yStdFallRate", "yMeanFallRate",
    "dMax", "dStdRate", "dMeanRate", "mAtZero",
]
LOWER_BETTER = ["ratioMaxX", "yStdRate", "yStdFallRate", "yMeanFallRate", "dMax", "dStdRate", "dMeanRate", "mAtZero"]
FEATURE_WEIGHTS = {
    "ratioMax": 33, "ratioMaxX": 6, "yMax": 30, "yStdRate": 15, "yMeanRate": 18, "yStdFallRate": 21,
    "yMeanFallRate": 24, "dMax": 27, "dStdRate": 9, "dMeanRate": 12, "mAtZero": 3,
}

REGIMES = ["A", "N", "R"]
COLUMNS = [f"{r}_{f}" for r in REGIMES for f in FEATURES]
LOWER = [c for c in COLUMNS if c.split("_", 1)[1] in LOWER_BETTER]
HIGHER = [c for c in COLUMNS if c not in LOWER]
WEIGHTS = {f"{r}_{f}": w for r in REGIMES for f, w in FEATURE_WEIGHTS.items()}
ORACLES: dict[str, str] = {}


def fl(expression: str, name: str | None = None) -> str:
    out = f"CAST(CAST({expression} AS FLOAT) AS DOUBLE) + 0.0"
    return f"{out} AS {name or expression}"


def fls(*names: str) -> str:
    return ", ".join(fl(n) for n in names)


# ---- points to series features --------------------------------------------------


def points(entity: str = "l_suppkey", y: str = "l_extendedprice - 20000", d: str = "l_extendedprice / l_quantity") -> str:
    return f"""pts AS MATERIALIZED (
  SELECT {entity} AS entity, l_returnflag AS regime,
    row_number() OVER (PARTITION BY {entity}, l_returnflag
      ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos,
    CAST(date_diff('day', DATE '1995-07-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS x,
    CAST({y} AS DOUBLE) AS y, CAST({d} AS DOUBLE) AS d, l_tax - CAST(0.04 AS DOUBLE) AS m
  FROM lineitem)"""


EVENT_POINTS = """pts AS MATERIALIZED (
  SELECT user_id AS entity, event_type AS regime,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos,
    CAST(event_id - 500 AS DOUBLE) AS x, value - 5 AS y, value + 1 AS d,
    TRY_CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) AS m
  FROM events WHERE user_id IS NOT NULL)"""


def vector_points(extra: str = "") -> str:
    """The series made of each embedding, three regimes rotated by 21 places."""
    return f"""vec AS (
  SELECT vec_id, unnest([0, 1, 2]) AS k, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 1000000) AS BIGINT)) AS v
  FROM embeddings), cell AS (
  SELECT vec_id, k, unnest(range(len(v))) AS i, len(v) AS n, v FROM vec), val AS (
  SELECT vec_id, k, i, v[(i + 21 * k) % n + 1] AS u, v[(i + 7 + 21 * k) % n + 1] AS w FROM cell), pts AS MATERIALIZED (
  SELECT CAST(vec_id AS VARCHAR) AS entity, vec_id, k, ['200000', '500000', '1000000'][k + 1] AS regime, i AS pos,
    CAST(i - 16 AS DOUBLE) AS x, CAST(u AS DOUBLE) AS y, CAST(1000 + 10 * i + abs(u) % 97 AS DOUBLE) AS d,
    CAST(w AS DOUBLE) AS m FROM val){extra}"""


SERIES = """, top AS (
  SELECT entity, regime, max(y) AS y FROM pts GROUP BY ALL), pk AS MATERIALIZED (
  SELECT entity, regime, min(pos) AS peak FROM pts JOIN top USING (entity, regime, y) GROUP BY ALL), rise AS (
  SELECT entity, regime, y - lag(y) OVER (PARTITION BY entity, regime ORDER BY pos) AS s
  FROM pts JOIN pk USING (entity, regime) WHERE pos < peak AND y > 0), fall AS (
  SELECT entity, regime, y - lag(y) OVER (PARTITION BY entity, regime ORDER BY pos) AS s
  FROM pts JOIN pk USING (entity, regime) WHERE pos >= peak), cost AS (
  SELECT entity, regime, d, d - lag(d) OVER (PARTITION BY entity, regime ORDER BY pos) AS s
  FROM pts JOIN pk USING (entity, regime) WHERE pos < peak AND x >= 0), zero AS (
  SELECT entity, regime, m, row_number() OVER (PARTITION BY entity, regime ORDER BY pos) AS r FROM pts WHERE x >= 0), ratio AS (
  SELECT entity, regime, y / d AS q, x, row_number() OVER (PARTITION BY entity, regime ORDER BY y / d DESC, pos) AS r
  FROM pts WHERE d <> 0), a_all AS (
  SELECT entity, regime, count(*) AS n_points,
    count(*) FILTER (WHERE x IS NULL OR y IS NULL OR d IS NULL OR m IS NULL OR isnan(d)) AS n_bad, max(y) AS yMax
  FROM pts GROUP BY ALL), a_rise AS (
  SELECT entity, regime, stddev_pop(s) AS yStdRate, avg(s) AS yMeanRate FROM rise GROUP BY ALL), a_fall AS (
  SELECT entity, regime, stddev_pop(s) AS yStdFallRate, abs(avg(s)) AS yMeanFallRate FROM fall GROUP BY ALL), a_cost AS (
  SELECT entity, regime, max(d) AS dMax, stddev_pop(s) AS dStdRate, avg(s) AS dMeanRate FROM cost GROUP BY ALL), series AS MATERIALIZED (
  SELECT entity, regime, n_points, n_bad, peak AS peak_pos, n_points - peak AS n_fall,
    q AS ratioMax, ratio.x AS ratioMaxX, yMax, yStdRate, yMeanRate, yStdFallRate, yMeanFallRate,
    dMax, dStdRate, dMeanRate, abs(zero.m) AS mAtZero
  FROM a_all JOIN pk USING (entity, regime) LEFT JOIN a_rise USING (entity, regime) LEFT JOIN a_fall USING (entity, regime)
    LEFT JOIN a_cost USING (entity, regime)
    LEFT JOIN zero ON zero.entity = a_all.entity AND zero.regime = a_all.regime AND zero.r = 1
    LEFT JOIN ratio ON ratio.entity = a_all.entity AND ratio.regime = a_all.regime AND ratio.r = 1)"""


def gate(order: str = "", least: int = 3, fall: int = 7) -> str:
    order = order or "regime"
    return f""", why AS (
  SELECT *, CASE WHEN n_bad > 0 THEN 'non-numeric values in series (regime=' || regime || ')'
    WHEN n_fall < {fall} THEN 'insufficient fall region (regime=' || regime || ')' END AS why FROM series), gate AS (
  SELECT entity, count(*) AS n_series, CASE WHEN count(*) < {least} THEN 'fewer than {least} regimes available'
    ELSE arg_min(why, {order}) FILTER (WHERE why IS NOT NULL) END AS reason
  FROM why GROUP BY entity)"""


def widen(regimes: list[str] = REGIMES) -> str:
    picks = ", ".join(f"max({f}) FILTER (WHERE regime = '{r}') AS {r}_{f}" for r in regimes for f in FEATURES)
    return f""", wide AS MATERIALIZED (SELECT entity, {picks} FROM series GROUP BY entity)"""


def first_missing(columns: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} IS NULL THEN 'missing {c}'" for c in columns) + " END"


def entity_table(columns: list[str] = COLUMNS) -> str:
    return f""", ent AS MATERIALIZED (
  SELECT wide.*, CASE WHEN reason IS NOT NULL THEN 'validation' WHEN {first_missing(columns)} IS NOT NULL THEN 'features' END AS stage,
    coalesce(reason, {first_missing(columns)}) AS reason
  FROM wide JOIN gate USING (entity))"""


PTS = "WITH " + points()
SER = PTS + SERIES
ENT = SER + gate() + widen() + entity_table()
FEATS = ENT + ", feats AS MATERIALIZED (SELECT * EXCLUDE (stage, reason) FROM ent WHERE reason IS NULL)"
ATTRS = """, attrs AS (
  SELECT s_suppkey AS entity, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS attr_a, CAST(s_nationkey AS DOUBLE) AS attr_b
  FROM supplier)"""
RANGE_REASON = """CASE WHEN attr_a < 500 THEN 'attr_a < 500.0' WHEN attr_a > 9000 THEN 'attr_a > 9000.0'
  WHEN attr_b < 2 THEN 'attr_b < 2.0' WHEN attr_b > 22 THEN 'attr_b > 22.0' END"""
ALL_FEATURES = f"entity, regime, n_points, n_bad, peak_pos, n_fall, {fls(*FEATURES)}"

# ---- sources, sinks, ingest -------------------------------------------------------

ORACLES["scan_series"] = f"{PTS} SELECT entity, regime, {fls('x', 'y', 'd', 'm')} FROM pts"
ORACLES["stage_roundtrip"] = f"{SER + widen()} SELECT entity, {fls(*COLUMNS)} FROM wide"
ORACLES["incremental_append"] = f"{SER} SELECT CAST(entity AS VARCHAR) AS entity, regime, n_points, {fls('yMax')} FROM series"
ORACLES["ingest_modes"] = """
WITH s AS (SELECT DISTINCT l_suppkey, l_returnflag, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT CAST(1 AS BIGINT) AS step, 'fresh' AS mode, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_entities FROM s WHERE s_nationkey < 12
UNION ALL SELECT 2, 'resume', count(*), count(DISTINCT l_suppkey) FROM s
UNION ALL SELECT 3, 'reuse', count(*), count(DISTINCT l_suppkey) FROM s
UNION ALL SELECT 4, 'fresh', count(*), count(DISTINCT l_suppkey) FROM s WHERE s_nationkey >= 20"""
ORACLES["resume_todo"] = """
SELECT c_custkey AS entity, c_name FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')"""
ORACLES["marker_rows"] = """
SELECT c_custkey AS entity, count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus IS NULL) AS n_markers
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"""
ORACLES["without_markers"] = """
SELECT c_custkey AS entity, o_orderstatus AS regime, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_orderstatus IS NOT NULL"""
ORACLES["ingest_progress"] = """
WITH saved AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (
  SELECT (SELECT count(*) FROM customer) AS total,
    (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT k FROM saved)) AS skipped,
    (SELECT count(*) FROM saved WHERE k IS NOT NULL) AS saved_entities)
SELECT total, skipped, total - skipped AS remaining, saved_entities, saved_entities >= total AS complete FROM c"""
LINKS = r"""links AS (
  SELECT page_id, regexp_extract_all(html, '<nav[^>]*>(.*?)</nav>', 1, 's')[1] AS nav FROM pages), pair AS (
  SELECT page_id, regexp_extract_all(nav, '<a ([^>]*)>(.*?)</a>', 1, 's') AS attrs,
    regexp_extract_all(nav, '<a ([^>]*)>(.*?)</a>', 2, 's') AS label FROM links), each AS (
  SELECT page_id, unnest(range(len(attrs))) AS place, unnest(attrs) AS attrs, unnest(label) AS label FROM pair), link AS (
  SELECT page_id, place, replace(trim(label), '&amp;', '&') AS label, regexp_extract(attrs, 'href="([^"]*)"', 1) AS href
  FROM each WHERE trim(label) <> '' AND regexp_extract(attrs, 'href="([^"]*)"', 1) <> '')"""
ORACLES["page_links"] = f"WITH {LINKS} SELECT page_id, CAST(place AS BIGINT) AS place, label, href FROM link"
ORACLES["page_worklist"] = f"""WITH {LINKS}
SELECT substr(href, 2) AS entity, count(*) AS n_links FROM link WHERE href LIKE '/_%' GROUP BY 1"""

LANDED = vector_points(
    """, line AS (
  SELECT *, vec_id % 31 <> 9 AND NOT (vec_id % 23 = 8 AND k = 2) AS present,
    vec_id % 19 <> 6 AS whole, NOT ((vec_id + pos) % 13 = 5 AND (vec_id + pos) % 17 <> 3) AS kept, max(y) OVER (PARTITION BY vec_id, k) AS best FROM pts), parsed AS MATERIALIZED (
  SELECT entity, vec_id, regime, CASE WHEN vec_id % 11 <> 4 THEN best END AS ratioMax,
    CAST(vec_id % 16 AS DOUBLE) AS ratioMaxX, row_number() OVER (PARTITION BY vec_id, k ORDER BY pos) - 1 AS pos, x, y,
    CASE WHEN NOT (vec_id % 5 = 2 AND (vec_id * 7 + pos) % 29 = 11) THEN d END AS d, CAST(pos AS DOUBLE) AS dp, m,
    CASE WHEN (vec_id + pos) % 17 <> 3 AND (vec_id + pos) % 19 <> 6 THEN CAST(0.5 AS DOUBLE) END AS top,
    CASE WHEN (vec_id + pos) % 17 <> 3 THEN CAST(1 AS DOUBLE) END AS bottom
  FROM line WHERE present AND whole AND kept)"""
)
ORACLES["parse_series_text"] = f"""WITH {LANDED}
SELECT entity, regime, ratioMax, ratioMaxX, pos, x, y, d, dp, m, top, bottom FROM parsed"""
ORACLES["parse_header_map"] = f"""WITH {LANDED}, f AS (
  SELECT DISTINCT entity, vec_id, regime, CAST(CAST(best AS BIGINT) AS VARCHAR) AS best FROM line WHERE present)
SELECT entity, regime, unnest(['Key', 'Entity', 'Regime', 'Ncrit', 'Mach',
    CASE WHEN vec_id % 11 = 4 THEN 'Other' ELSE 'Max Cl/Cd' END, 'Max Cl/Cd alpha']) AS k,
  unnest([entity || '-' || regime, entity, regime, '9', '0,0', CASE WHEN vec_id % 11 = 4 THEN '1' ELSE best END,
    CAST(vec_id % 16 AS VARCHAR)]) AS v FROM f"""
ORACLES["malformed_lines"] = r"""
WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS ls FROM documents), k AS (
  SELECT doc_id, ls, list_filter(ls, lambda v: trim(v) <> '' AND len(string_split(v, ',')) <= 3) AS kept FROM l)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(kept) AS BIGINT) AS n_kept, md5(array_to_string(kept, '|')) AS kept_md5 FROM k"""
ORACLES["coerce_numeric"] = rf"""
WITH c AS (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS cells FROM documents), n AS (
  SELECT doc_id, cells, list_filter(list_transform(list_transform(cells, lambda v: regexp_replace(v, '^["\s]+|["\s]+$', '', 'g')),
    lambda v: CASE WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
      OR regexp_full_match(lower(v), '[+-]?inf(inity)?') THEN TRY_CAST(v AS DOUBLE) END), lambda v: v IS NOT NULL) AS nums FROM c)
SELECT doc_id, CAST(len(cells) AS BIGINT) AS n_cells, CAST(len(nums) AS BIGINT) AS n_numbers,
  {fl('list_max(nums)', 'largest')}, {fl('list_min(nums)', 'smallest')} FROM n"""
ORACLES["page_metrics"] = """
SELECT page_id AS entity,
  CASE WHEN page_id % 7 <> 3 THEN page_id % 23 + CAST(0.5 AS DOUBLE) END AS attr_a_value,
  CASE WHEN page_id % 7 <> 3 THEN CAST(length(url) % 41 AS DOUBLE) END AS attr_a_place,
  CASE WHEN page_id % 5 <> 1 THEN CAST(length(url) % 13 AS DOUBLE) END AS attr_b_value,
  CAST(30.25 AS DOUBLE) AS attr_b_place
FROM pages"""
ORACLES["page_text"] = r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'),
    '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis') AS h FROM pages), u AS (
  SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'),
    '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS h FROM t), v AS (
  SELECT page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) AS t FROM u)
SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM v"""
ORACLES["enumerate_series"] = f"""WITH {LANDED}
SELECT p.entity, regime, 'label ' || any_value(e.label) AS desc, any_value(CAST(quality AS BIGINT)) AS attr_a, count(*) AS n_points
FROM parsed p JOIN embeddings e USING (vec_id) LEFT JOIN labels ON doc_id = vec_id
WHERE regime IN ('200000', '500000') GROUP BY p.entity, regime"""
ORACLES["stream_ingest"] = f"""WITH {LANDED}, b AS (
  SELECT entity, regime, max(y) AS best FROM parsed GROUP BY ALL)
SELECT entity, regime, count(*) AS n_points, count(*) FILTER (WHERE d IS NULL) AS n_bad, min(pos) FILTER (WHERE y = best) AS peak_pos
FROM parsed JOIN b USING (entity, regime) GROUP BY entity, regime"""
ORACLES["stage_metrics"] = f"""{ENT + ATTRS}, j AS (
  SELECT coalesce(stage, CASE WHEN attr_a IS NULL THEN 'attributes' WHEN {RANGE_REASON} IS NOT NULL THEN 'range' END, 'kept') AS s
  FROM ent LEFT JOIN attrs USING (entity)), c AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE s = 'validation') AS v, count(*) FILTER (WHERE s = 'features') AS f,
    count(*) FILTER (WHERE s = 'attributes') AS a, count(*) FILTER (WHERE s = 'range') AS r FROM j)
SELECT 'validation' AS stage, n AS rows_in, n - v AS kept, v AS dropped FROM c
UNION ALL SELECT 'features', n - v, n - v - f, f FROM c
UNION ALL SELECT 'attributes', n - v - f, n - v - f - a, a FROM c
UNION ALL SELECT 'range', n - v - f - a, n - v - f - a - r, r FROM c"""

# ---- projections, filters, strings ---------------------------------------------------

ORACLES["split_label"] = """
SELECT p_partkey, p_brand AS name, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name || ' - ' || p_type END AS desc FROM part"""
ORACLES["extract_key"] = r"""
WITH k AS (SELECT page_id, nullif(regexp_extract(url, '\?(.*&)?ref=(.+)$', 2), '') AS key FROM pages)
SELECT page_id, key, '/landed?key=' || key || '-A' AS address FROM k"""
ORACLES["feature_projection"] = f"{FEATS} SELECT {fls(*COLUMNS)} FROM feats"
ORACLES["direction_split"] = (
    ENT
    + " SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{'lower' if c in LOWER else 'higher'}' AS direction, count({c}) AS n_values FROM ent"
        for c in COLUMNS
    )
    + ")"
)
NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS)
ORACLES["complete_cases"] = f"{SER + widen()} SELECT entity, {fls(*COLUMNS)} FROM wide WHERE {NOT_NULL}"
ORACLES["drop_incomplete"] = f"""{SER + widen()}
SELECT entity, CASE WHEN {NOT_NULL} THEN '' ELSE 'features' END AS stage, coalesce({first_missing(COLUMNS)}, '') AS reason FROM wide"""
ORACLES["attr_required"] = f"""{FEATS + ATTRS}
SELECT entity, {fls('attr_a')}, attr_b FROM feats JOIN attrs USING (entity) WHERE attr_a IS NOT NULL AND attr_b IS NOT NULL"""
ORACLES["range_filter"] = f"""WITH {ATTRS[2:]}
SELECT entity, {fls('attr_a')}, attr_b FROM attrs WHERE attr_a BETWEEN 500 AND 9000 AND attr_b BETWEEN 2 AND 22"""
ORACLES["range_reject_reason"] = f"""WITH {ATTRS[2:]}
SELECT entity, {RANGE_REASON} AS reason FROM attrs WHERE {RANGE_REASON} IS NOT NULL"""
ORACLES["missing_attr_report"] = f"""WITH {ATTRS[2:]}, m AS (
  SELECT entity, row_number() OVER (ORDER BY entity) AS r FROM attrs WHERE attr_a IS NULL)
SELECT count(*) AS n_missing, coalesce(string_agg(CASE WHEN r <= 10 THEN CAST(entity AS VARCHAR) END, ',' ORDER BY r), '') AS first_entities FROM m"""
ORACLES["filter_attributes"] = f"""{FEATS + ATTRS}
SELECT entity, CASE WHEN attr_a IS NULL THEN 'attributes' WHEN {RANGE_REASON} IS NOT NULL THEN 'range' ELSE 'kept' END AS stage,
  CASE WHEN attr_a IS NULL THEN 'missing attr_a' ELSE coalesce({RANGE_REASON}, '') END AS reason
FROM feats LEFT JOIN attrs USING (entity)"""

# ---- validation -------------------------------------------------------------------------

PART = "WITH " + points("l_partkey") + SERIES
ORACLES["validate_min_regimes"] = f"""
WITH s AS (SELECT l_orderkey AS entity, count(DISTINCT l_returnflag) AS n_series FROM lineitem GROUP BY 1), {points('l_orderkey')}, last AS (
  SELECT entity, regime, max(y) AS y, max(pos) + 1 AS n FROM pts GROUP BY ALL), pk AS (
  SELECT entity, regime, n - min(pos) AS n_fall FROM pts JOIN last USING (entity, regime, y) GROUP BY entity, regime, n), f AS (
  SELECT entity, bool_or(n_fall < 7) AS short FROM pk GROUP BY entity)
SELECT entity, n_series, CASE WHEN n_series < 3 THEN true WHEN short THEN false END AS too_few FROM s JOIN f USING (entity)"""
ORACLES["validate_numeric"] = f"""WITH {points(d="CASE WHEN l_tax * l_quantity < CAST(3.9 AS DOUBLE) THEN 100 END")}
SELECT entity, regime, count(*) AS n_points, count(*) FILTER (WHERE d IS NULL) AS n_bad,
  'non-numeric values in series (regime=' || regime || ')' AS reason
FROM pts GROUP BY entity, regime HAVING count(*) FILTER (WHERE d IS NULL) > 0"""
ORACLES["validate_fall_region"] = f"""{PART}
SELECT entity, regime, n_points, peak_pos, n_fall,
  CASE WHEN n_fall < 7 THEN 'insufficient fall region (regime=' || regime || ')' END AS reason FROM series"""
ORACLES["reject_reasons"] = f"""{PART + gate()}
SELECT entity, 'validation' AS stage, reason FROM gate WHERE reason IS NOT NULL"""
ORACLES["all_rejects"] = f"{ENT} SELECT entity, stage, reason FROM ent WHERE reason IS NOT NULL"
ORACLES["valid_entities"] = f"{SER + gate()} SELECT entity FROM gate WHERE reason IS NULL"

# ---- series features ------------------------------------------------------------------------

ORACLES["series_peak"] = f"""WITH {points(y='l_quantity') + SERIES} SELECT entity, regime, n_points, peak_pos, {fls('yMax')} FROM series"""
ORACLES["filtered_diff"] = f"""{PTS}, kept AS (SELECT * FROM pts WHERE y > 0 AND x >= 0), d AS (
  SELECT entity, regime, x, y, y - lag(y) OVER (PARTITION BY entity, regime ORDER BY pos) AS rise_step FROM kept)
SELECT entity, regime, {fls('x', 'y', 'rise_step')} FROM d"""
for _name, _columns in {
    "feat_y_max": ["yMax"],
    "feat_rise_rate": ["yStdRate", "yMeanRate"],
    "feat_fall_rate": ["yStdFallRate", "yMeanFallRate"],
    "feat_cost": ["dMax", "dStdRate", "dMeanRate"],
    "feat_first_crossing": ["mAtZero"],
    "feat_ratio_peak": ["ratioMax", "ratioMaxX"],
}.items():
    ORACLES[_name] = f"{SER} SELECT entity, regime, {fls(*_columns)} FROM series"
ORACLES["series_features"] = f"{SER} SELECT {ALL_FEATURES} FROM series"
ORACLES["series_features_split"] = ORACLES["series_features"]
ORACLES["series_features_parts"] = f"{PART} SELECT {ALL_FEATURES} FROM series"
ORACLES["series_features_arrays"] = f"WITH {vector_points() + SERIES} SELECT {ALL_FEATURES} FROM series"
ORACLES["wide_features"] = ORACLES["stage_roundtrip"]
_EVENT_COLUMNS = [f"{r}_{f}" for r in ("click", "error") for f in FEATURES]
ORACLES["regime_subset"] = f"""WITH {EVENT_POINTS + SERIES
    + gate("CASE regime WHEN 'click' THEN '0' WHEN 'error' THEN '1' ELSE '2' || regime END", 4, 2)
    + widen(['click', 'error'])}
SELECT entity, reason AS gate, {fls(*_EVENT_COLUMNS)} FROM wide JOIN gate USING (entity)"""

# ---- joins ------------------------------------------------------------------------------------

ORACLES["attach_attributes"] = f"""{FEATS + ATTRS}
SELECT entity, {fls(COLUMNS[2], 'attr_a')}, attr_b FROM feats LEFT JOIN attrs USING (entity)"""
ORACLES["first_per_key"] = """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_custkey IS NOT NULL)
WHERE r = 1"""
ORACLES["series_attributes"] = """
WITH s AS (SELECT l_partkey AS entity, l_returnflag AS regime, count(*) AS attr_a FROM lineitem GROUP BY ALL)
SELECT entity, attr_a, regime FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY
  CASE regime WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, regime) AS r FROM s) WHERE r = 1"""

# ---- column statistics ----------------------------------------------------------------------------


def each(expression: str, columns: list[str] = COLUMNS) -> str:
    """The expression once per column; @ stands for the column."""
    return ", ".join(f"{expression.replace('@', c)} AS {c}" for c in columns)


SCALED = FEATS + f", scaled AS MATERIALIZED (SELECT entity, {each('(@ - min(@) OVER ()) / (max(@) OVER () - min(@) OVER ())')} FROM feats)"
REPLACED = SCALED + f", repl AS MATERIALIZED (SELECT entity, {each('CASE WHEN @ = 0 THEN min(CASE WHEN @ <> 0 THEN @ END) OVER () ELSE @ END')} FROM scaled)"
INVERTED = REPLACED + f", inv AS MATERIALIZED (SELECT entity, {each('1 / @', LOWER)}, {', '.join(HIGHER)} FROM repl)"
_CV = ", ".join(f"stddev_samp({c}) / avg({c}) AS {c}" for c in COLUMNS)
WEIGHTED = INVERTED + f", cv AS MATERIALIZED (SELECT {_CV} FROM inv), total AS (SELECT {' + '.join(COLUMNS)} AS t FROM cv)"
ORACLES["column_stats"] = (
    FEATS
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, {fl(f'avg({c})', 'mean')}, {fl(f'stddev_samp({c})', 'std')}, "
        f"{fl(f'min({c})', 'low')}, {fl(f'max({c})', 'high')}, {fl(f'sum({c})', 'total')} FROM feats"
        for c in COLUMNS
    )
)


def per_column(prefix: str, expression: str, source: str) -> str:
    cells = ", ".join(fl(expression.replace("@", c), c) for c in COLUMNS)
    return f"{prefix} SELECT entity, {cells} FROM {source}"


ORACLES["zscore_eps"] = per_column(FEATS, "(@ - avg(@) OVER ()) / (stddev_samp(@) OVER () + 1e-12)", "feats")
ORACLES["zscore_sample"] = per_column(FEATS, "(@ - avg(@) OVER ()) / stddev_samp(@) OVER ()", "feats")
ORACLES["minmax_scale"] = per_column(SCALED, "@", "scaled")
ORACLES["column_share"] = per_column(FEATS, "@ / sum(@) OVER ()", "feats")
ORACLES["zero_replace"] = per_column(REPLACED, "@", "repl")
ORACLES["invert_lower"] = per_column(INVERTED, "@", "inv")
ORACLES["cv_weights"] = (
    WEIGHTED + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {fl(f'{c} / t', 'weight')} FROM cv, total" for c in COLUMNS)
)

# ---- rankings -----------------------------------------------------------------------------------------

_SHARES = ", ".join(f"inv.{c} / sum(inv.{c}) OVER () * cv.{c} / t AS {c}" for c in COLUMNS)
CV_RANK = WEIGHTED + f""", part_score AS (SELECT entity, {_SHARES} FROM inv, cv, total), cv_score AS (
  SELECT entity, {' + '.join(COLUMNS)} AS score_cv FROM part_score), r_cv AS MATERIALIZED (
  SELECT entity, score_cv, rank() OVER (ORDER BY score_cv DESC) AS rank_cv FROM cv_score)"""
ORACLES["rank_cv"] = f"{CV_RANK} SELECT entity, {fls('score_cv')}, rank_cv FROM r_cv"


def weighted(source: str, name: str) -> str:
    total = sum(WEIGHTS.values())
    terms = " + ".join(
        f"{'-' if c in LOWER else ''}({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () * {WEIGHTS[c]} / {total}.0" for c in COLUMNS
    )
    return f""", z_{name} AS (SELECT entity, {terms} AS score_final FROM {source}), {name} AS MATERIALIZED (
  SELECT entity, score_final, rank() OVER (ORDER BY score_final DESC) AS rank_final FROM z_{name})"""


ORACLES["rank_zscore_weighted"] = f"{FEATS + weighted('feats', 'w')} SELECT entity, {fls('score_final')}, rank_final FROM w"
NOMINATED = ", nom AS (SELECT entity, 'cv' AS source_methods FROM (SELECT * FROM r_cv ORDER BY rank_cv, entity LIMIT 5)), pool AS MATERIALIZED (SELECT * FROM feats JOIN nom USING (entity))"
ORACLES["restart_from_stage"] = f"""{CV_RANK + NOMINATED + weighted('pool', 'w')}
SELECT entity, {fls('score_final')}, rank_final, 'cv' AS source_methods FROM w"""
THREE = CV_RANK + """, r_peak AS MATERIALIZED (SELECT entity, rank() OVER (ORDER BY R_yMax DESC) AS rank_peak FROM feats), r_steady AS MATERIALIZED (
  SELECT entity, rank() OVER (ORDER BY A_yStdFallRate) AS rank_steady FROM feats), nom AS (
  SELECT 0 AS o, 'peak' AS method, entity, rank_peak AS rank FROM (SELECT * FROM r_peak ORDER BY rank_peak, entity LIMIT 5)
  UNION ALL SELECT 1, 'cv', entity, rank_cv FROM (SELECT * FROM r_cv ORDER BY rank_cv, entity LIMIT 5)
  UNION ALL SELECT 2, 'steady', entity, rank_steady FROM (SELECT * FROM r_steady ORDER BY rank_steady, entity LIMIT 5)), named AS (
  SELECT entity, string_agg(method, ', ' ORDER BY o) AS source_methods FROM nom GROUP BY entity), pool AS MATERIALIZED (
  SELECT * FROM feats JOIN named USING (entity))"""
ORACLES["candidate_pool"] = f"{THREE} SELECT entity, {fls(COLUMNS[2])}, source_methods FROM pool"
ORACLES["custom_ranker"] = f"""{THREE + weighted('pool', 'w')}
SELECT rank_final, entity, {fls('score_final')}, source_methods FROM w JOIN named USING (entity)"""
ORACLES["summary_join"] = f"""{THREE + weighted('pool', 'w')}
SELECT entity, {fls('score_final')}, rank_final, source_methods, rank_peak, rank_cv, rank_steady
FROM w JOIN named USING (entity) JOIN r_peak USING (entity) JOIN r_cv USING (entity) JOIN r_steady USING (entity)"""
ORACLES["topn_report"] = f"""{THREE}
SELECT method, row_number() OVER (PARTITION BY method ORDER BY rank, entity) AS place, entity, rank FROM nom"""
ORACLES["global_rank"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, rank() OVER (ORDER BY l_quantity DESC) AS rank_quantity FROM lineitem"""
ORACLES["global_rank_ascending"] = f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_totalprice > 2000 THEN o_totalprice END AS o_totalprice FROM orders)
SELECT o_orderkey, {fls('o_totalprice')}, CASE WHEN o_totalprice IS NOT NULL
  THEN rank() OVER (ORDER BY o_totalprice NULLS LAST) END AS rank_price FROM o"""
ORACLES["topk"] = """
SELECT p_partkey, p_size, rank() OVER (ORDER BY p_retailprice DESC) AS rank_price FROM part ORDER BY rank_price, p_partkey LIMIT 25"""
ORACLES["union_by_name"] = """
SELECT s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer"""

# ---- factor analysis ------------------------------------------------------------------------------------

ORACLES["correlation_matrix"] = (
    FEATS
    + ", c AS MATERIALIZED (SELECT "
    + ", ".join(f"corr({a}, {b}) AS c{i}_{j}" for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS) if i <= j)
    + " FROM feats) SELECT a, b, "
    + fl("r")
    + " FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, c{min(i, j)}_{max(i, j)} AS r FROM c" for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS)
    )
    + ")"
)
ORACLES["factor_reconstruction"] = ORACLES["correlation_matrix"]


# Eigenpairs by repeated squaring: a correlation matrix squared and scaled to trace 1 tends to the projector on its
# first eigenvector; the pair is then subtracted and the next one found. The row of the projector with the largest
# diagonal, over the root of that, is the vector whose largest component is positive.
SQUARINGS = 18


def eigen(name: str, columns: list[str], count: int) -> str:
    p = len(columns)
    outer = "list_transform(v, lambda a: list_transform(v, lambda b: a * b * l))"
    minus = f"list_transform(list_zip(R, {outer}), lambda r: list_transform(list_zip(r[1], r[2]), lambda c: c[1] - c[2]))"
    return f""", l_{name} AS MATERIALIZED (SELECT entity, unnest([{', '.join(columns)}]) AS v, unnest(range({p})) AS i FROM feats), c_{name} AS (
  SELECT a.i AS i, b.i AS j, corr(a.v, b.v) AS r FROM l_{name} a JOIN l_{name} b USING (entity) GROUP BY a.i, b.i), m_{name} AS (
  SELECT list(row_ ORDER BY i) AS R FROM (SELECT i, list(r ORDER BY j) AS row_ FROM c_{name} GROUP BY i)), pw_{name} AS (
  SELECT 0 AS f, 0 AS it, R, R AS S, CAST(0 AS DOUBLE) AS lam, CAST([] AS DOUBLE[]) AS vec FROM m_{name}
  UNION ALL
  SELECT CASE WHEN it = {SQUARINGS} THEN f + 1 ELSE f END, CASE WHEN it = {SQUARINGS} THEN 0 ELSE it + 1 END,
    CASE WHEN it = {SQUARINGS} THEN {minus} ELSE R END,
    CASE WHEN it = {SQUARINGS} THEN {minus}
      ELSE list_transform(S, lambda a: list_transform(S, lambda b: list_dot_product(a, b) / t)) END,
    l, v
  FROM (
    SELECT f, it, R, S, t, list_transform(S[top], lambda c: c / sqrt(S[top][top])) AS v,
      list_sum(list_transform(list_zip(R, S), lambda r: list_dot_product(r[1], r[2]))) AS l
    FROM (
      SELECT f, it, R, S, list_sum(list_transform(S, lambda a: list_dot_product(a, a))) AS t,
        list_position(list_transform(range(1, {p + 1}), lambda k: S[k][k]),
          list_max(list_transform(range(1, {p + 1}), lambda k: S[k][k]))) AS top
      FROM pw_{name} WHERE f < {count}))), e_{name} AS MATERIALIZED (
  SELECT CAST(f AS BIGINT) AS factor, lam, vec FROM pw_{name} WHERE it = 0 AND f > 0)"""


def kept(name: str, cap: int) -> str:
    return f", k_{name} AS MATERIALIZED (SELECT * FROM e_{name} WHERE factor <= {cap} AND (lam > 1 OR factor = 1))"


def scored(name: str, columns: list[str]) -> str:
    z = ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-12)" for c in columns)
    return f""", z_{name} AS MATERIALIZED (SELECT entity, [{z}] AS z FROM feats), s_{name} AS MATERIALIZED (
  SELECT entity, factor, list_dot_product(z, vec) / sqrt(lam) AS score, lam / {len(columns)} AS share FROM z_{name}, k_{name})"""


RECURSIVE = FEATS.replace("WITH ", "WITH RECURSIVE ", 1)
_COUNT = 16
JOINT = eigen("j", COLUMNS, _COUNT) + kept("j", 10)
NAMES = "[" + ", ".join(f"'{c}'" for c in COLUMNS) + "]"
ORACLES["factor_eigen"] = f"""{RECURSIVE + JOINT}, u AS (
  SELECT factor, lam AS eigenvalue, unnest({NAMES}) AS feature, unnest(vec) AS component FROM k_j)
SELECT factor, feature, {fls('eigenvalue', 'component')} FROM u"""
ORACLES["factor_loadings"] = f"""{RECURSIVE + JOINT}, u AS (
  SELECT factor, lam, unnest({NAMES}) AS feature, unnest(vec) AS c FROM k_j)
SELECT feature, factor, {fl('c * sqrt(lam)', 'loading')} FROM u"""
ORACLES["variance_table"] = f"""{RECURSIVE + JOINT}
SELECT factor, {fl('lam', 'eigenvalue')}, {fl(f'lam / {len(COLUMNS)}', 'variance')},
  {fl(f'sum(lam) OVER (ORDER BY factor) / {len(COLUMNS)}', 'cumulative')} FROM k_j"""
ORACLES["factor_scores"] = f"""{RECURSIVE + JOINT + scored('j', COLUMNS)} SELECT entity, factor, {fls('score')} FROM s_j"""
BOTH = eigen("l", LOWER, _COUNT) + kept("l", 8) + eigen("g", HIGHER, len(HIGHER)) + kept("g", 3)
_GROUPS = (("lower", "l", LOWER), ("higher", "g", HIGHER), ("joint", "j", COLUMNS))
ORACLES["factor_count"] = f"{RECURSIVE + JOINT + BOTH} " + " UNION ALL ".join(
    f"""SELECT '{group}' AS columns, (SELECT count(*) FROM e_{n} WHERE lam > 1) AS above_one,
  (SELECT count(*) FROM k_{n}) AS kept, {fl(f'(SELECT sum(lam) FROM k_{n}) / {len(columns)}', 'explained')}"""
    for group, n, columns in _GROUPS
)
FACTOR_RANK = BOTH + scored("l", LOWER) + scored("g", HIGHER) + """, t_l AS (
  SELECT entity, sum(score * share) AS score_L FROM s_l GROUP BY entity), t_g AS (
  SELECT entity, sum(score * share) AS score_G FROM s_g GROUP BY entity), r_factor AS MATERIALIZED (
  SELECT *, rank_L + rank_G AS rank_sum FROM (
    SELECT entity, score_L, score_G, rank() OVER (ORDER BY score_L) AS rank_L, rank() OVER (ORDER BY score_G DESC) AS rank_G
    FROM t_l JOIN t_g USING (entity)))"""
ORACLES["rank_factor"] = f"""{RECURSIVE + FACTOR_RANK}
SELECT entity, {fls('score_L', 'score_G')}, rank_L, rank_G, rank_sum FROM r_factor"""
CV_FACTOR_RANK = JOINT + scored("j", COLUMNS) + """, f1 AS (
  SELECT entity, factor, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS x
  FROM s_j WINDOW w AS (PARTITION BY factor)), f2 AS (
  SELECT entity, factor, CASE WHEN x = 0 THEN min(CASE WHEN x <> 0 THEN x END) OVER (PARTITION BY factor) ELSE x END AS x FROM f1), f3 AS MATERIALIZED (
  SELECT entity, factor, CASE WHEN factor = 1 THEN x ELSE 1 / x END AS x FROM f2), f4 AS (
  SELECT factor, sum(x) AS total, stddev_samp(x) / avg(x) AS cv FROM f3 GROUP BY factor), f5 AS (
  SELECT factor, total, cv / sum(cv) OVER () AS weight FROM f4), f6 AS (
  SELECT entity, sum(x / total * weight) AS score_cv_factor FROM f3 JOIN f5 USING (factor) GROUP BY entity), r_cvf AS MATERIALIZED (
  SELECT entity, score_cv_factor, rank() OVER (ORDER BY score_cv_factor DESC) AS rank_cv_factor FROM f6)"""
ORACLES["rank_cv_factor"] = f"""{RECURSIVE + CV_FACTOR_RANK} SELECT entity, {fls('score_cv_factor')}, rank_cv_factor FROM r_cvf"""
FULL = CV_RANK.replace("WITH ", "WITH RECURSIVE ", 1) + FACTOR_RANK + CV_FACTOR_RANK + """, nom AS (
  SELECT 0 AS o, 'factor' AS method, entity FROM (SELECT * FROM r_factor ORDER BY rank_sum, entity LIMIT 5)
  UNION ALL SELECT 1, 'cv', entity FROM (SELECT * FROM r_cv ORDER BY rank_cv, entity LIMIT 5)
  UNION ALL SELECT 2, 'cv-factor', entity FROM (SELECT * FROM r_cvf ORDER BY rank_cv_factor, entity LIMIT 5)), named AS (
  SELECT entity, string_agg(method, ', ' ORDER BY o) AS source_methods FROM nom GROUP BY entity), pool AS MATERIALIZED (
  SELECT * FROM feats JOIN named USING (entity))""" + weighted("pool", "w")
ORACLES["saved_models"] = ORACLES["factor_count"]
ORACLES["saved_scores"] = f"""{CV_RANK.replace("WITH ", "WITH RECURSIVE ", 1) + FACTOR_RANK + CV_FACTOR_RANK}
SELECT entity, {fls('score_L', 'score_G', 'score_cv', 'score_cv_factor')}
FROM r_factor JOIN r_cv USING (entity) JOIN r_cvf USING (entity)"""
LANDED_SERIES = (
    f"""WITH pts AS MATERIALIZED (
  WITH {LANDED} SELECT entity, CASE regime WHEN '200000' THEN 'A' WHEN '500000' THEN 'N' ELSE 'R' END AS regime, pos, x, y, d, m,
    ratioMax AS given, ratioMaxX AS given_x FROM parsed WHERE vec_id % 29 <> 3)"""
    + SERIES.replace("series AS MATERIALIZED", "computed AS MATERIALIZED")
    + """, head AS (SELECT entity, regime, any_value(given) AS given, any_value(given_x) AS given_x FROM pts GROUP BY ALL), series AS MATERIALIZED (
  SELECT computed.* REPLACE (given AS ratioMax, given_x AS ratioMaxX) FROM computed JOIN head USING (entity, regime))"""
)
# The regimes by their numbers' text: 1000000 before 200000 before 500000 is not the order asked for.
LANDED_FEATS = LANDED_SERIES + gate() + widen() + entity_table() + """, pg AS (
  SELECT CAST(vec_id AS VARCHAR) AS entity, vec_id % 23 + CAST(0.5 AS DOUBLE) AS attr_a_value,
    CASE WHEN vec_id % 37 <> 5 THEN CAST(vec_id % 13 AS DOUBLE) END AS attr_b_value FROM embeddings), tagged AS MATERIALIZED (
  SELECT ent.* EXCLUDE (stage, reason), coalesce(stage, CASE WHEN attr_b_value IS NULL THEN 'attributes'
      WHEN attr_a_value < 2 OR attr_a_value > 20 OR attr_b_value < 1 THEN 'range' END) AS stage,
    coalesce(reason, CASE WHEN attr_b_value IS NULL THEN 'missing attr_b_value' WHEN attr_a_value < 2 THEN 'attr_a_value < 2.0'
      WHEN attr_a_value > 20 THEN 'attr_a_value > 20.0' WHEN attr_b_value < 1 THEN 'attr_b_value < 1.0' END) AS reason
  FROM ent LEFT JOIN pg USING (entity)), feats AS MATERIALIZED (SELECT * EXCLUDE (stage, reason) FROM tagged WHERE stage IS NULL)"""
_NUMBERS = "replace(replace(replace(reason, '=A)', '=200000)'), '=N)', '=500000)'), '=R)', '=1000000)')"
_NUMBERS = f"replace(replace(replace({_NUMBERS}, 'missing A_', 'missing 200000_'), 'missing N_', 'missing 500000_'), 'missing R_', 'missing 1000000_')"
ORACLES["landed_rejects"] = f"{LANDED_FEATS} SELECT entity, stage, {_NUMBERS} AS reason FROM tagged WHERE stage IS NOT NULL"
LANDED_FULL = FULL.replace(FEATS.replace("WITH ", "WITH RECURSIVE ", 1), LANDED_FEATS.replace("WITH ", "WITH RECURSIVE ", 1), 1)
ORACLES["landed_to_summary"] = f"""{LANDED_FULL}
SELECT entity, {fls('score_final')}, rank_final, source_methods, rank_sum AS rank_factor, rank_cv, rank_cv_factor
FROM w JOIN named USING (entity) JOIN r_factor USING (entity) JOIN r_cv USING (entity) JOIN r_cvf USING (entity)"""
ORACLES["final_ranking"] = f"{FULL} SELECT entity, {fls('score_final')}, rank_final, source_methods FROM w JOIN named USING (entity)"
ORACLES["final_summary"] = f"""{FULL}
SELECT entity, {fls('score_final')}, rank_final, source_methods, rank_sum AS rank_factor, rank_cv, rank_cv_factor
FROM w JOIN named USING (entity) JOIN r_factor USING (entity) JOIN r_cv USING (entity) JOIN r_cvf USING (entity)"""
