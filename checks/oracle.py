"""SQL for the same results, built from shared CTEs, for DuckDB.

Values are rounded half-up on both sides, see ``hu``.
"""

from __future__ import annotations

from checks import literals as fixed

ORACLE: dict[str, str] = {}


def hu(x: str, digits: int = 0) -> str:
    scale = f"1e{digits}"
    return f"(floor(({x})*{scale}+0.5)/{scale})"


def hl(x: str) -> str:
    return f"CAST(floor(({x})+0.5) AS BIGINT)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def listed(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def add(name: str, *parts: str) -> None:
    *ctes, body = parts
    ORACLE[name] = (with_(*ctes) if ctes else "") + body


# --- views -------------------------------------------------------------------

F = """f AS (
  SELECT l_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS customer_id,
         o_orderstatus AS status, p_type AS product, p_brand AS brand, r_name AS region,
         c_mktsegment AS segment, l_quantity AS units, l_extendedprice AS revenue,
         p_retailprice * l_quantity AS cost, l_extendedprice / l_quantity AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""

R = """r0 AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS event,
    CASE WHEN event_id % 31 = 0 THEN strftime(ts, '%-m/%-d/%Y') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
    CAST(user_id AS VARCHAR) AS user_id,
    CASE WHEN event_id % 29 = 0 THEN '  ' || kind || ' ' ELSE kind END AS event_type,
    CASE WHEN event_id % 19 = 0 THEN '-' WHEN event_id % 23 = 0 THEN '£' || v ELSE v END AS value,
    props
  FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v,
               CASE WHEN event_id % 17 = 0 THEN 'N/A' ELSE event_type END AS kind FROM events)),
r AS (SELECT * EXCLUDE (event_id) FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE event_id < 200))"""

W = """w_sales AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
         CAST(o_custkey AS VARCHAR) AS customer_id, CAST(l_partkey AS VARCHAR) AS part_id,
         CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w_inventory AS (SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_size * 20 AS VARCHAR) AS inventory FROM part),
w_customers AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM customer),
w_products AS (SELECT CAST(p_partkey AS VARCHAR) AS part_id, p_name AS product, p_brand AS brand, p_type AS type,
                      CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM part),
w_expenses AS (SELECT CAST(s_suppkey AS VARCHAR) AS ledger_code,
                      CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS cost FROM supplier)"""

W_COLUMNS = {
    "sales": ["order_id", "order_date", "customer_id", "part_id", "quantity", "revenue"],
    "inventory": ["part_id", "inventory"],
    "customers": ["customer_id", "customer_name", "segment"],
    "products": ["part_id", "product", "brand", "type", "price"],
    "expenses": ["ledger_code", "cost"],
}
R_COLUMNS = ["event", "ts", "user_id", "event_type", "value", "props"]


def cells(source: str, dataset: str, columns: list[str]) -> str:
    parts = [
        f"SELECT '{dataset}' AS dataset, {i} AS position, '{c}' AS column_name, coalesce({c}, '') AS raw FROM {source}"
        for i, c in enumerate(columns)
    ]
    return " UNION ALL ".join(parts)


CELLS_R = f"cells AS ({cells('r', 'events', R_COLUMNS)})"
CELLS_W = "cells AS (" + " UNION ALL ".join(
    cells(f"w_{name}", name, columns) for name, columns in W_COLUMNS.items()) + ")"


# --- values ------------------------------------------------------------------

MARKERS = listed(fixed.MISSING_MARKERS)


def missing(c: str) -> str:
    return f"(lower(trim({c})) IN ({MARKERS}))"


def number(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '[£$€,\\s]', '', 'g'), '%$', '')"
    return f"(CASE WHEN regexp_matches({bare}, '{fixed.NUMBER_TEXT}') THEN TRY_CAST({bare} AS DOUBLE) END)"


def is_date(c: str) -> str:
    shapes = [fixed.ISO_DAY, fixed.SLASH_DAY, fixed.DAY_MONTH_NAME, fixed.MONTH_NAME_DAY]
    return "(" + " OR ".join(f"regexp_matches(trim({c}), '{s}')" for s in shapes) + ")"


def day(c: str) -> str:
    return (f"(CASE WHEN regexp_matches(trim({c}), '{fixed.ISO_DAY}') THEN TRY_CAST(left(trim({c}), 10) AS DATE) "
            f"WHEN regexp_matches(trim({c}), '{fixed.SLASH_DAY}') "
            f"THEN CAST(try_strptime(trim({c}), '%m/%d/%Y') AS DATE) END)")


add("coerced_values", R, f"""SELECT event, {number('value')} AS number, {missing('event_type')} AS type_missing,
  {missing('value')} AS value_missing, {is_date('ts')} AS is_date, {day('ts')} AS day,
  regexp_matches(lower(trim(event_type)), '^(true|false|yes|no|y|n)$') AS is_boolean FROM r""")

_prefix = f"TRY_CAST(nullif(regexp_extract(regexp_replace(value, '[£$€,]', '', 'g'), '{fixed.LEADING_NUMBER}', 1), '') AS DOUBLE)"
add("lenient_amounts", R, f"""SELECT user_id, {hu(f"sum(coalesce({number('value')}, 0))", 2)} AS amount,
  {hu(f"sum(coalesce({_prefix}, 0))", 2)} AS price,
  {hu(f"sum(CASE WHEN {_prefix} IS NULL OR {_prefix} = 0 THEN 1 ELSE {_prefix} END)", 2)} AS quantity
FROM r GROUP BY user_id""")

add("half_up_rounding", f"""SELECT s_suppkey, {hu('s_acctbal')} AS whole, {hu('-s_acctbal/2', 1)} AS one_digit,
  {hu('floor(s_acctbal) * -0.5e0')} AS halves FROM supplier""")

# --- sources -----------------------------------------------------------------

add("csv_round_trip", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, o_orderpriority FROM orders""")
add("tsv_scan", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
add("json_scan", """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
  '{"k":"' || CAST(json_extract(props, '$.k') AS VARCHAR) || '"}' AS props FROM events""")
add("csv_line_breaks", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text,
  coalesce('say "' || source || '"', '') AS source FROM documents""")
add("csv_ragged", """WITH cut AS (
  SELECT [CAST(c_custkey AS VARCHAR), c_mktsegment] || CASE WHEN c_custkey % 3 > 0 THEN [CAST(c_nationkey AS VARCHAR)] ELSE [] END
    || CASE WHEN c_custkey % 5 = 0 THEN ['more'] ELSE [] END AS cells FROM customer)
SELECT cells[1] AS key, cells[2] AS segment, coalesce(cells[3], '') AS nation,
  CASE WHEN len(cells) <> 3 THEN array_to_string(cells, ',') END AS raw FROM cut""")
add("json_array_scan", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
  '{"key":"' || o_custkey || '"}' AS customer FROM orders""")
add("latest_runs", """SELECT o_custkey AS dataset, position, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position
  FROM orders) WHERE position <= 3""")

# --- profiling ---------------------------------------------------------------

PROFILE = f"""tested AS (
  SELECT *, trim(raw) AS v, NOT {missing('raw')} AS present, length(raw) AS chars FROM cells),
flagged AS (
  SELECT *, CASE WHEN present THEN {number('v')} END AS number, present AND {is_date('v')} AS is_date,
    CASE WHEN present THEN {day('v')} END AS day,
    present AND regexp_matches(lower(v), '^(true|false|yes|no|y|n)$') AS is_boolean,
    present AND regexp_matches(lower(v), '^(true|false|yes|no|y|n|0|1)$') AS is_bit,
    present AND regexp_matches(v, '{fixed.PADDED_ISO_DAY}') AS is_padded,
    present AND regexp_matches(v, '{fixed.PLAIN_NUMBER}') AS is_plain,
    present AND regexp_matches(v, '[£$€]') AS has_currency,
    present AND regexp_matches(v, '%\\s*$') AS has_percent,
    present AND regexp_matches(v, '{fixed.EMAIL}') AS is_email,
    present AND regexp_matches(v, '{fixed.POSTCODE}') AS is_postcode,
    present AND regexp_matches(v, '{fixed.ITEM_CODE}') AS is_item_code,
    present AND regexp_matches(v, '{fixed.ISO_DAY}|{fixed.SLASH_DAY}') AS is_date_shaped
  FROM tested),
summed AS (
  SELECT dataset, position, column_name, count(*) AS rows, count(*) FILTER (present) AS non_missing,
    count(DISTINCT CASE WHEN present THEN v END) AS distinct_values,
    sum(CASE WHEN present THEN chars END) AS chars, count(number) AS as_number,
    count(*) FILTER (is_date) AS as_date, count(*) FILTER (is_boolean) AS as_boolean,
    count(*) FILTER (is_bit) AS as_bit, count(*) FILTER (is_padded) AS padded_iso,
    count(*) FILTER (is_plain) AS plain_numbers, count(*) FILTER (has_currency) AS with_currency,
    count(*) FILTER (has_percent) AS with_percent, count(*) FILTER (is_email) AS as_email,
    count(*) FILTER (is_postcode) AS as_postcode, count(*) FILTER (is_item_code) AS as_item_code,
    count(*) FILTER (is_date_shaped) AS date_shaped,
    list_sort(list(DISTINCT v) FILTER (present))[1:8] AS samples,
    min(number) AS lo, max(number) AS hi, avg(number) AS av, quantile_cont(number, 0.5) AS med,
    stddev_pop(number) AS sdev, min(day) AS d1, max(day) AS d2, count(DISTINCT date_trunc('month', day)) AS mths
  FROM flagged GROUP BY ALL),
kinds AS (
  SELECT *, CASE WHEN non_missing = 0 THEN 'empty' WHEN as_number / non_missing >= 0.9 THEN 'number'
    WHEN as_date / non_missing >= 0.85 THEN 'date' WHEN as_boolean / non_missing >= 0.95 THEN 'boolean'
    ELSE 'string' END AS inferred_type FROM summed),
prof AS (
  SELECT dataset, position, column_name, inferred_type, rows, non_missing, rows - non_missing AS missing,
    {hu('(rows - non_missing) / rows * 100', 1)} AS missing_pct, distinct_values,
    CASE WHEN non_missing > 0 THEN {hu('distinct_values / non_missing', 3)} ELSE 0 END AS uniqueness,
    distinct_values <= 1 AND non_missing > 0 AS is_constant, samples,
    CASE WHEN non_missing > 0 THEN {hl('chars / non_missing')} ELSE 0 END AS avg_length,
    CASE WHEN inferred_type = 'number' THEN lo END AS "min", CASE WHEN inferred_type = 'number' THEN hi END AS "max",
    CASE WHEN inferred_type = 'number' THEN av END AS mean, CASE WHEN inferred_type = 'number' THEN med END AS median,
    CASE WHEN inferred_type = 'number' THEN sdev END AS sd,
    CASE WHEN inferred_type = 'date' THEN d1 END AS first_day, CASE WHEN inferred_type = 'date' THEN d2 END AS last_day,
    CASE WHEN inferred_type = 'date' THEN mths END AS months,
    as_number, as_date, as_boolean, as_bit, padded_iso, plain_numbers, with_currency, with_percent,
    as_email, as_postcode, as_item_code, date_shaped
  FROM kinds)"""

PROFILE_OUT = f"""SELECT * REPLACE ({big('position')} AS position, coalesce(array_to_string(samples, '|'), '') AS samples,
  {hu('mean', 4)} AS mean, {hu('median', 4)} AS median, {hu('sd', 4)} AS sd) FROM prof"""

add("inferred_types", R, CELLS_R, PROFILE,
    "SELECT column_name, non_missing, as_number, as_date, as_boolean, inferred_type FROM prof")
add("profile_columns", R, CELLS_R, PROFILE, PROFILE_OUT)
add("profile_catalog", W, CELLS_W, PROFILE, PROFILE_OUT)
DUPLICATES = """dups AS (SELECT 'events' AS dataset, 6::BIGINT AS columns, (SELECT count(*) FROM r) AS rows,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS distinct_rows)"""
add("distinct_by_hash", """SELECT DISTINCT l_returnflag, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS l_quantity,
  strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem""")
add("duplicate_rows", R, DUPLICATES, "SELECT *, rows - distinct_rows AS duplicates FROM dups")
add("duplicate_documents", """SELECT 'documents' AS dataset, 1::BIGINT AS columns, count(*) AS rows,
  count(DISTINCT text) AS distinct_rows, count(*) - count(DISTINCT text) AS duplicates FROM documents""")

# --- cleaning ----------------------------------------------------------------

CLEAN = f"""std AS (SELECT DISTINCT {', '.join(f"CASE WHEN NOT {missing(c)} THEN trim({c}) END AS {c}" for c in R_COLUMNS)} FROM r),
norm AS (
  SELECT event, CAST({day('ts')} AS VARCHAR) AS ts, user_id, event_type, {number('value')} AS value, props FROM std),
mom AS (SELECT avg(value) AS m, quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd FROM norm),
numfill AS (SELECT abs(m - med) / (CASE WHEN sd > 0 THEN sd ELSE 1 END) > 0.5 AS skewed,
  CASE WHEN abs(m - med) / (CASE WHEN sd > 0 THEN sd ELSE 1 END) > 0.5 THEN med ELSE m END AS fill FROM mom),
modefill AS (SELECT event_type AS fill FROM norm WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)"""

add("clean_rows", R, CLEAN, f"""SELECT event, ts, user_id, coalesce(event_type, (SELECT fill FROM modefill)) AS event_type,
  {hu('coalesce(value, (SELECT fill FROM numfill))', 4)} AS value, props FROM norm""")
add("fill_values", R, CLEAN, f"""SELECT 'value' AS column_name,
  CASE WHEN skewed THEN 'impute_numeric_median' ELSE 'impute_numeric_mean' END AS method,
  CAST(NULL AS VARCHAR) AS label, {hu('fill', 4)} AS number FROM numfill
UNION ALL SELECT 'event_type', 'impute_categorical_mode', fill, NULL FROM modefill""")

_BY_TYPE = """tmom AS (SELECT event_type, avg(value) AS m, quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd
  FROM norm WHERE value IS NOT NULL GROUP BY event_type),
tfill AS (SELECT event_type, abs(m - med) / (CASE WHEN sd > 0 THEN sd ELSE 1 END) > 0.5 AS skewed,
  CASE WHEN abs(m - med) / (CASE WHEN sd > 0 THEN sd ELSE 1 END) > 0.5 THEN med ELSE m END AS fill FROM tmom)"""
add("fill_values_by_type", R, CLEAN, _BY_TYPE, f"""SELECT event_type, CASE WHEN skewed THEN 'impute_numeric_median' ELSE 'impute_numeric_mean' END AS method,
  {hu('fill', 4)} AS number FROM tfill""")
add("gaps_filled_by_type", R, CLEAN, _BY_TYPE, f"""SELECT n.event_type, count(coalesce(value, fill)) AS n,
  {hu('sum(CAST(coalesce(value, fill) AS DECIMAL(38,4)))::DOUBLE', 2)} AS total
FROM norm n LEFT JOIN tfill t ON n.event_type IS NOT DISTINCT FROM t.event_type GROUP BY n.event_type""")

_trim = " + ".join(f"CASE WHEN trim({c}) <> {c} THEN 1 ELSE 0 END" for c in R_COLUMNS)
_mark = " + ".join(f"CASE WHEN trim({c}) <> '' AND {missing(c)} THEN 1 ELSE 0 END" for c in R_COLUMNS)


def plain(x: str) -> str:
    return (f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE rtrim(CAST(CAST({x} AS DECIMAL(28,10)) AS VARCHAR), '0') END)")


add("cleaning_log", R, CLEAN, f"""SELECT * FROM (
SELECT 'trim_values' AS action, CAST(NULL AS VARCHAR) AS column_name, {big(f'sum({_trim})')} AS n FROM r
UNION ALL SELECT 'standardise_missing', NULL, {big(f'sum({_mark})')} FROM r
UNION ALL SELECT 'remove_duplicate_rows', NULL, (SELECT count(*) FROM r) - (SELECT count(*) FROM std)
UNION ALL SELECT 'convert_numeric', 'event', count(*) FROM std WHERE {plain(number('event'))} <> event
UNION ALL SELECT 'convert_numeric', 'user_id', count(*) FROM std WHERE {plain(number('user_id'))} <> user_id
UNION ALL SELECT 'convert_numeric', 'value', count(*) FROM std WHERE {plain(number('value'))} <> value
UNION ALL SELECT 'convert_date', 'ts', count(*) FROM std WHERE CAST({day('ts')} AS VARCHAR) <> ts
UNION ALL SELECT (SELECT CASE WHEN skewed THEN 'impute_numeric_median' ELSE 'impute_numeric_mean' END FROM numfill), 'value', count(*) FROM std WHERE value IS NULL
UNION ALL SELECT 'impute_categorical_mode', 'event_type', count(*) FROM std WHERE event_type IS NULL) WHERE n > 0""")
add("typed_rejects", R, f"""SELECT 'value' AS column_name, count(*) FILTER (NOT {missing('value')} AND {number('value')} IS NULL) AS n FROM r
UNION ALL SELECT 'ts', count(*) FILTER (NOT {missing('ts')} AND {day('ts')} IS NULL) FROM r
UNION ALL SELECT 'event_type', count(*) FILTER (NOT {missing('event_type')} AND {number('event_type')} IS NULL) FROM r""")

# --- quality -----------------------------------------------------------------

QUALITY = f"""qroles AS (SELECT * FROM (VALUES ('event','identifier'), ('ts','date'), ('user_id','customer'),
  ('event_type','category'), ('value','revenue')) AS t(column_name, role)),
qa AS (
  SELECT p.*, coalesce(q.role, 'unknown') AS role, greatest(0e0, 100 - missing_pct) AS completeness,
    CASE WHEN non_missing = 0 THEN 100e0 ELSE {hu('''(CASE inferred_type WHEN 'number' THEN as_number WHEN 'date' THEN as_date
      WHEN 'boolean' THEN as_bit ELSE non_missing END) / non_missing * 100''', 1)} END AS validity,
    CASE WHEN non_missing < 2 THEN 100e0 ELSE {hu('''(CASE inferred_type WHEN 'number' THEN plain_numbers
      WHEN 'date' THEN padded_iso ELSE non_missing END) / non_missing * 100''', 1)} END AS consistency,
    CASE WHEN q.role = 'identifier' THEN {hu('uniqueness * 100', 1)} ELSE 100e0 END AS uniq
  FROM prof p LEFT JOIN qroles q USING (column_name)),
qc AS (SELECT dataset, column_name, role, inferred_type, completeness, validity, consistency, uniq AS uniqueness,
  {hl('completeness*0.4e0 + validity*0.3e0 + consistency*0.2e0 + uniq*0.1e0')} AS score FROM qa),
dp AS (SELECT {hu('(rows - distinct_rows) / rows * 100', 1)} AS duplicate_pct FROM dups),
qm AS (SELECT dataset, {hl('avg(completeness)')} AS completeness, {hl('avg(validity)')} AS validity,
  {hl('avg(consistency)')} AS consistency, {hl('avg(uniqueness)')} AS uniqueness FROM qc GROUP BY dataset)"""
_Q = (R, CELLS_R, PROFILE, DUPLICATES, QUALITY)
add("quality_columns", *_Q, "SELECT * FROM qc")
add("quality_dataset", *_Q, f"""SELECT qm.*, duplicate_pct, greatest(0, least(100, {hl('''completeness*0.4e0 + validity*0.3e0
  + consistency*0.2e0 + uniqueness*0.1e0 - least(15e0, duplicate_pct)''')})) AS score FROM qm, dp""")
add("quality_flags", *_Q, f"""SELECT dataset, column_name, 'incomplete' AS flag, {hu('100 - completeness')} AS value FROM qc WHERE completeness < 70
UNION ALL SELECT dataset, column_name, 'invalid_values', {hu('validity')} FROM qc WHERE validity < 85 AND inferred_type <> 'string'
UNION ALL SELECT dataset, column_name, 'repeated_identifier', {hu('uniqueness')} FROM qc WHERE role = 'identifier' AND uniqueness < 98
UNION ALL SELECT 'events', NULL, 'duplicate_rows', duplicate_pct FROM dp WHERE duplicate_pct > 1""")

add("quality_flags_by_nation", f"""nations AS (
  SELECT 'nation ' || c_nationkey AS dataset, c_nationkey AS nation, avg(CASE WHEN c_acctbal > 2000 THEN 100e0 ELSE 0 END) AS completeness,
    avg(CASE WHEN c_acctbal > 800 THEN 100e0 ELSE 0 END) AS validity, avg(CASE WHEN c_custkey % 37 > 0 THEN 100e0 ELSE 0 END) AS uniqueness,
    {hu("count_if(c_custkey % 50 = 0) / count(*) * 100", 1)} AS twice
  FROM customer GROUP BY c_nationkey)""", f"""SELECT dataset, 'balance' AS column_name, 'incomplete' AS flag, {hu('100 - completeness')} AS value FROM nations WHERE completeness < 70
UNION ALL SELECT dataset, 'balance', 'invalid_values', {hu('validity')} FROM nations WHERE validity < 85 AND nation % 2 = 0
UNION ALL SELECT dataset, 'balance', 'repeated_identifier', {hu('uniqueness')} FROM nations WHERE nation % 3 = 0 AND uniqueness < 98
UNION ALL SELECT dataset, NULL, 'duplicate_rows', twice FROM nations WHERE twice > 1""")

# --- roles and gates ---------------------------------------------------------

_hints = ", ".join(f"({i}, '{role}', '{h}')" for i, (role, hs) in enumerate(fixed.ROLE_HINTS.items()) for h in hs)


def share(count: str) -> str:
    return f"({count} / non_missing)"


_DATE_F, _SIGN_F, _PCT_F, _MAIL_F, _POST_F, _CODE_F = map(
    share, ("date_shaped", "with_currency", "with_percent", "as_email", "as_postcode", "as_item_code"))
_numeric = listed(fixed.NUMERIC_ROLES)

SCORES = f"""hints(role_order, role, hint) AS (VALUES {_hints}),
named AS (
  SELECT p.dataset, p.column_name, h.role, any_value(h.role_order) AS role_order,
    max(CASE WHEN trim(regexp_replace(lower(p.column_name), '[_\\-\\s]+', ' ', 'g')) = h.hint THEN 0.55e0
      WHEN contains(trim(regexp_replace(lower(p.column_name), '[_\\-\\s]+', ' ', 'g')), h.hint) THEN 0.4e0 END) AS w1
  FROM prof p, hints h WHERE p.inferred_type <> 'empty' GROUP BY 1, 2, 3),
weighed AS (
  SELECT n.*, p.position, p.inferred_type, p.non_missing, p.as_email, p.as_item_code, p.rows, p.months,
    CASE WHEN n.role = 'date' AND {_DATE_F} >= 0.5 THEN 0.3e0 * {_DATE_F}
      WHEN n.role IN ('price','cost','revenue') AND {_SIGN_F} > 0 THEN 0.25e0 * {_SIGN_F}
      WHEN n.role = 'percentage' AND {_PCT_F} > 0 THEN 0.25e0 * {_PCT_F}
      WHEN n.role = 'percentage' AND p."min" >= 0 AND p."max" <= 100 THEN 0.12e0
      WHEN n.role = 'customer' AND {_MAIL_F} >= 0.5 THEN 0.25e0 * {_MAIL_F}
      WHEN n.role = 'location' AND {_POST_F} >= 0.3 THEN 0.2e0
      WHEN n.role IN ('identifier','product') AND {_CODE_F} >= 0.5 THEN 0.15e0 * {_CODE_F} END AS w2,
    CASE WHEN n.role IN ({_numeric}) THEN CASE WHEN p.inferred_type = 'number' THEN 0.2e0 ELSE -0.5e0 END
      WHEN n.role = 'date' THEN CASE WHEN p.inferred_type = 'date' THEN 0.2e0 ELSE -0.5e0 END END AS w3,
    CASE WHEN n.role = 'identifier' THEN CASE WHEN uniqueness > 0.9 THEN 0.2e0 WHEN uniqueness > 0.7 THEN 0.1e0 END
      WHEN n.role = 'customer' AND uniqueness > 0.4 AND uniqueness < 0.98 THEN 0.15e0
      WHEN n.role IN ('category','status') AND distinct_values BETWEEN 1 AND 30 AND uniqueness < 0.15 THEN 0.15e0
      WHEN n.role = 'product' AND uniqueness > 0.02 AND uniqueness < 0.6 THEN 0.1e0
      WHEN n.role = 'location' AND distinct_values BETWEEN 1 AND 60 AND rows > 20 THEN 0.1e0 END AS w4,
    CASE WHEN n.role = 'percentage' AND p."min" >= 0 AND p."max" <= 100 THEN 0.1e0
      WHEN n.role = 'quantity' AND p."min" >= 0 THEN 0.1e0
      WHEN n.role IN ('price','cost','revenue') AND p."min" IS NOT NULL
        THEN CASE WHEN p."min" >= 0 THEN 0.1e0 ELSE -0.15e0 END END AS w5
  FROM named n JOIN prof p USING (dataset, column_name)),
scores AS (
  SELECT *, least(1e0, greatest(0e0, coalesce(w1,0e0) + coalesce(w2,0e0) + coalesce(w3,0e0) + coalesce(w4,0e0) + coalesce(w5,0e0))) AS score
  FROM weighed)"""

ROLES_BASE = """ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset, column_name ORDER BY score DESC, role_order) AS rk FROM scores),
top1 AS (SELECT *, CASE WHEN score >= 0.2 THEN role ELSE 'unknown' END AS found FROM ranked WHERE rk = 1),
alts AS (SELECT dataset, column_name, string_agg(role, ',' ORDER BY rk) AS alternatives FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.dataset, r.column_name ORDER BY r.rk) AS ak
  FROM ranked r JOIN top1 t USING (dataset, column_name) WHERE r.role <> t.found AND r.score >= 0.15)
  WHERE ak <= 3 GROUP BY 1, 2)"""


def roles_cte(overridden: bool) -> str:
    picked = "CASE WHEN t.dataset = 'products' AND t.column_name = 'brand' THEN 'category' END" if overridden \
        else "CAST(NULL AS VARCHAR)"
    return f"""{ROLES_BASE},
picked AS (SELECT t.*, {picked} AS picked, coalesce(alternatives, '') AS alternatives
  FROM top1 t LEFT JOIN alts USING (dataset, column_name)),
finals AS (SELECT *, coalesce(picked, found) AS final FROM picked),
roles AS (
  SELECT dataset, column_name, position, inferred_type, rows, months, final AS role,
    CASE WHEN final IN ('price','cost','revenue') THEN 'currency' WHEN final IN ('quantity','inventory') THEN 'count'
      WHEN final IN ('date','percentage') THEN final
      WHEN final = 'customer' AND {_MAIL_F} > 0 THEN 'email'
      WHEN final = 'identifier' OR (final = 'product' AND {_CODE_F} > 0) THEN 'code'
      WHEN final IN ('category','status','location') THEN 'category_label'
      WHEN inferred_type = 'boolean' THEN 'boolean' WHEN inferred_type = 'string' THEN 'free_text'
      ELSE 'unknown' END AS display_type,
    CASE WHEN picked IS NOT NULL THEN 1e0 ELSE {hu('score', 2)} END AS confidence,
    picked IS NULL AND score < 0.6 AS needs_review, alternatives
  FROM finals)"""


_C = (W, CELLS_W, PROFILE, SCORES)
_CR = (*_C, roles_cte(True))
_CR0 = (*_C, roles_cte(False))
add("role_scores", *_C, f"""SELECT dataset, column_name, role, {hu('score', 4)} AS score,
  concat_ws(',', CASE WHEN w1 IS NOT NULL THEN 'name_match' END, CASE WHEN w2 IS NOT NULL THEN 'value_pattern' END,
    CASE WHEN w3 IS NOT NULL THEN 'type_consistency' END, CASE WHEN w4 IS NOT NULL THEN 'cardinality' END,
    CASE WHEN w5 IS NOT NULL THEN 'range_check' END) AS evidence FROM scores""")
add("column_roles", *_CR, """SELECT dataset, column_name, inferred_type, role, display_type, confidence, needs_review, alternatives FROM roles""")
add("mapping_warnings", *_CR, """SELECT dataset, 'no_date_column' AS warning, '' AS columns FROM roles GROUP BY dataset
  HAVING count(*) FILTER (role = 'date' AND confidence >= 0.5) = 0
UNION ALL SELECT dataset, 'no_money_column', '' FROM roles GROUP BY dataset
  HAVING count(*) FILTER (role IN ('revenue','price','cost') AND confidence >= 0.5) = 0
UNION ALL SELECT dataset, 'low_confidence', string_agg(column_name, ',' ORDER BY position) FROM roles
  WHERE needs_review AND role <> 'unknown' GROUP BY dataset""")
BEST = """best AS (SELECT dataset, role, column_name, confidence, position, months, rows FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, role ORDER BY confidence DESC, position) AS b
  FROM roles WHERE role <> 'unknown') WHERE b = 1)"""
add("best_columns", *_CR, BEST, "SELECT dataset, role, column_name, confidence FROM best")


def first_role(order: list[str]) -> str:
    return "coalesce(" + ", ".join(f"max(column_name) FILTER (role = '{r}')" for r in order) + ")"


_derived = ("CASE WHEN count(*) FILTER (role = 'price') > 0 AND count(*) FILTER (role = 'quantity') > 0 "
            "AND count(*) FILTER (role = 'revenue') = 0 THEN 'transaction_value' END")
add("primary_measures", *_CR, BEST, f"""SELECT dataset, coalesce({_derived}, {first_role(fixed.SERIES_MEASURES)}) AS series_measure,
  coalesce({_derived}, {first_role(fixed.BREAKDOWN_MEASURES)}) AS breakdown_measure FROM best GROUP BY dataset""")

_roles_needed = ["date", "revenue", "price", "cost", "quantity", "customer", "identifier", "category", "product", "location", "status"]
_pivot = ", ".join(
    f"max(b.column_name) FILTER (b.role = '{r}') AS n_{r}, max(b.confidence) FILTER (b.role = '{r}') AS c_{r}" for r in _roles_needed)
GATES = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY
    list_position(['price','cost','revenue','quantity','percentage','inventory','duration'], role), confidence DESC, position) AS nk
  FROM roles WHERE role IN ('price','cost','revenue','quantity','percentage','inventory','duration')),
sizes AS (SELECT dataset, max(rows) AS rows FROM roles GROUP BY dataset),
pivoted AS (SELECT s.dataset, s.rows, {_pivot}, coalesce(max(b.months) FILTER (b.role = 'date'), 0) AS months
  FROM sizes s LEFT JOIN best b ON s.dataset = b.dataset GROUP BY s.dataset, s.rows),
facts AS (SELECT p.*, coalesce(n_revenue, n_price, n_cost) AS n_money, coalesce(c_revenue, c_price, c_cost) AS c_money,
    coalesce(n_revenue, n_price, n_cost, n_quantity) AS n_measure, coalesce(c_revenue, c_price, c_cost, c_quantity) AS c_measure,
    coalesce(n_category, n_product, n_location, n_status) AS n_group, coalesce(c_category, c_product, c_location, c_status) AS c_group,
    coalesce(n_identifier, n_customer) AS n_who, coalesce(c_identifier, c_customer) AS c_who,
    a.column_name AS n_one, a.confidence AS c_one, z.column_name AS n_two, z.confidence AS c_two
  FROM pivoted p LEFT JOIN numbered a ON p.dataset = a.dataset AND a.nk = 1
  LEFT JOIN numbered z ON p.dataset = z.dataset AND z.nk = 2)"""

_RULES = [
    ("trend_analysis", ["date", "measure"], "true"), ("comparison", ["group", "measure"], "true"),
    ("distribution", ["measure"], "rows >= 10"), ("correlation", ["one", "two"], "rows >= 15"),
    ("segmentation", ["customer", "date", "money"], "true"), ("anomaly_detection", ["date", "measure"], "months >= 3"),
    ("forecasting", ["date", "measure"], "months >= 6"), ("concentration_analysis", ["group", "money"], "true"),
    ("cohort_analysis", ["customer", "date"], "months >= 2"), ("transaction_analysis", ["who", "date", "money"], "true"),
    ("seasonality", ["date", "measure"], "rows >= 30"),
]


def gate_sql(i: int, name: str, needed: list[str], condition: str) -> str:
    open_ = " AND ".join([condition, *[f"n_{c} IS NOT NULL" for c in needed]])
    mean = "(" + " + ".join(f"c_{c}" for c in needed) + f") / {len(needed)}"
    names = ", ".join(f"n_{c}" for c in needed)
    return (f"SELECT dataset, {i}::BIGINT AS sequence, '{name}' AS capability, {open_} AS available, "
            f"CASE WHEN {open_} THEN concat_ws(',', {names}) ELSE '' END AS columns, "
            f"CASE WHEN {open_} THEN {hu(mean, 2)} ELSE 0e0 END AS confidence FROM facts")


GATE_TABLE = "gates AS (" + " UNION ALL ".join(gate_sql(i + 1, *rule) for i, rule in enumerate(_RULES)) + ")"
add("analysis_gates", *_CR, BEST, GATES, GATE_TABLE, "SELECT * FROM gates")
add("analysis_ranking", *_CR, BEST, GATES, GATE_TABLE, f"""SELECT dataset, position, capability, score FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, sequence) AS position FROM (
    SELECT *, CAST(least(100, {hu("base * (CASE WHEN capability IN ('trend_analysis','forecasting') THEN 1.15e0 WHEN capability = 'segmentation' THEN 1.1e0 WHEN capability IN ('concentration_analysis','anomaly_detection') THEN 1.05e0 ELSE 1e0 END)")}) AS BIGINT) AS score
    FROM (SELECT *, {hu("confidence * 100 * (CASE WHEN capability = 'correlation' THEN 0.5e0 ELSE 1e0 END)")} AS base FROM gates WHERE available)))
  WHERE position <= 10""")

# --- features and statistics -------------------------------------------------

add("calendar_parts", f"""SELECT o_orderkey, {big('year(o_orderdate)')} AS year, {big('month(o_orderdate)')} AS month,
  strftime(o_orderdate, '%b %y') AS month_label, {big('dayofweek(o_orderdate)')} AS day_of_week,
  {big('quarter(o_orderdate)')} AS quarter, strftime(o_orderdate, '%Y-%m') AS month_key FROM orders""")
add("transaction_value", F, f"""SELECT order_id, {hu(f"sum({hu('price*units', 2)})", 2)} AS value, count(*) AS n FROM f GROUP BY order_id""")
M = f"""m AS (SELECT *, {hu('revenue - cost', 2)} AS margin,
  {hu('CASE WHEN revenue <> 0 THEN (revenue - cost) / revenue ELSE 0 END * 100', 1)} AS margin_pct FROM f)"""
add("margins", F, M, f"""SELECT order_id, {hu('sum(margin)', 2)} AS margin, {hu('min(margin_pct)', 1)} AS lowest_pct,
  {hu('max(margin_pct)', 1)} AS highest_pct FROM m GROUP BY order_id""")


def bands(by: str) -> str:
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}band, count(*) AS n, min(revenue) AS low, max(revenue) AS high FROM (
  SELECT *, CASE WHEN revenue <= q[1] THEN 'Low' WHEN revenue <= q[2] THEN 'Medium' WHEN revenue <= q[3] THEN 'High' ELSE 'Very High' END AS band
  FROM (SELECT *, quantile_cont(revenue, [0.25, 0.5, 0.75]) {over} AS q FROM f)) GROUP BY ALL"""


add("value_bands", F, bands(""))
add("value_bands_by_region", F, bands("region"))


def summary(columns: list[str], by: str) -> str:
    lead = f"{by}, " if by else ""
    long = " UNION ALL ".join(f"SELECT {lead}'{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM f" for c in columns)
    keys = f"{by}, column_name" if by else "column_name"
    return f"""SELECT {keys}, n, {hu('mean', 2)} AS mean, {hu('q[2]', 2)} AS median, {hu('q[1]', 2)} AS q1, {hu('q[3]', 2)} AS q3,
  {hu('sd', 2)} AS sd, {hu(hu('variance', 2))} AS variance, mode, "min", "max", outliers FROM (
  SELECT {keys}, count(*) AS n, avg(x) AS mean, any_value(q) AS q, stddev_pop(x) AS sd, var_pop(x) AS variance,
    min(x) AS "min", max(x) AS "max", count(*) FILTER (x < q[1] - 1.5*(q[3]-q[1]) OR x > q[3] + 1.5*(q[3]-q[1])) AS outliers
  FROM (SELECT *, quantile_cont(x, [0.25, 0.5, 0.75]) OVER (PARTITION BY {keys}) AS q FROM ({long})) GROUP BY {keys})
LEFT JOIN (SELECT {keys}, x AS mode FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, x) AS rk
  FROM (SELECT {keys}, x, count(*) AS c FROM ({long}) GROUP BY ALL) WHERE c >= 2) WHERE rk = 1) USING ({keys})"""


add("numeric_summary", F, summary(["revenue", "cost", "units"], ""))
add("numeric_summary_by_region", F, summary(["revenue", "units"], "region"))
add("outlier_examples", F, M, f"""SELECT product, position, {hu('margin_pct', 2)} AS value FROM (
  SELECT product, margin_pct, row_number() OVER (PARTITION BY product ORDER BY margin_pct DESC) AS position FROM (
    SELECT *, quantile_cont(margin_pct, [0.25, 0.75]) OVER (PARTITION BY product) AS q FROM m)
  WHERE margin_pct < q[1] - 1.5*(q[2]-q[1]) OR margin_pct > q[2] + 1.5*(q[2]-q[1])) WHERE position <= 10""")
add("category_frequencies", F, f"""SELECT column_name, position, label, n, {hu('n / total_rows * 100', 1)} AS pct, total_rows FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, label) AS position,
    {big('sum(n) OVER (PARTITION BY column_name)')} AS total_rows FROM (
    SELECT 'brand' AS column_name, brand AS label, count(*) AS n FROM f GROUP BY ALL
    UNION ALL SELECT 'region', region, count(*) FROM f GROUP BY ALL
    UNION ALL SELECT 'status', status, count(*) FROM f GROUP BY ALL)) WHERE position <= 15""")


def corr_rows(columns: list[str], by: str, source: str) -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    rows = [
        f"SELECT {lead}{k} AS pair, '{a}' AS column_a, '{b}' AS column_b, count(*) AS n, corr({a}, {b}) AS r FROM {source} {group}"
        for k, (a, b) in enumerate((a, b) for i, a in enumerate(columns) for b in columns[i + 1:])
    ]
    return f"""pairs AS (SELECT {lead}pair, column_a, column_b, n, {hu('r', 2)} AS coefficient,
  CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate'
    WHEN abs(r) < 0.7 THEN 'strong' ELSE 'very_strong' END AS strength,
  CASE WHEN r > 0.05 THEN 'positive' WHEN r < -0.05 THEN 'negative' ELSE 'none' END AS direction
  FROM ({' UNION ALL '.join(rows)}))"""


add("correlations", F, M, corr_rows(["revenue", "cost", "units", "price", "margin"], "", "m"), "SELECT * EXCLUDE (pair) FROM pairs")
add("correlations_by_region", F, corr_rows(["revenue", "cost", "units"], "region", "f"), "SELECT * EXCLUDE (pair) FROM pairs")
add("strongest_pair", F, corr_rows(["revenue", "cost", "units"], "", "f"),
    "SELECT * EXCLUDE (pair) FROM (SELECT * FROM pairs ORDER BY abs(coefficient) DESC, pair LIMIT 1) WHERE strength <> 'negligible'")
add("pair_points", F, """SELECT position, revenue AS x, units AS y FROM (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', order_id, CAST(units AS BIGINT), CAST(revenue AS DECIMAL(18,2))))) AS position FROM f) WHERE position <= 300""")


def series(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""s AS (SELECT {lead}CAST(date_trunc('month', order_date) AS DATE) AS month, {hu('sum(CAST(revenue AS DECIMAL(38,4)))::DOUBLE', 2)} AS value,
  count(*) AS n FROM f GROUP BY ALL)"""


add("monthly_series", F, series(), "SELECT * FROM s")
add("monthly_series_by_region", F, series("region"), "SELECT * FROM s")


def cycle(source: str, keys: str, slot: str, measure: str, labels: list[str], base: int) -> tuple[str, str]:
    slots = ", ".join(f"({i + base}, '{label}')" for i, label in enumerate(labels))
    lead = f"{keys}, " if keys else ""
    match = f"t.slot = k.slot AND t.{keys} = k.{keys}" if keys else "t.slot = k.slot"
    every = f"(SELECT * FROM (SELECT DISTINCT {keys} FROM {source}) CROSS JOIN (VALUES {slots}) AS v(slot, label))" if keys \
        else f"(VALUES {slots})"
    alias = "k" if keys else "k(slot, label)"
    pick = f"k.{keys}, " if keys else ""
    return (f"t AS (SELECT {lead}{slot} AS slot, {hu(f'sum({measure})', 2)} AS value, count(*) AS n FROM {source} GROUP BY ALL)",
            f"""SELECT {pick}{big('k.slot')} AS slot, k.label, coalesce(t.value, 0) AS value, coalesce(t.n, 0) AS n
FROM {every} AS {alias} LEFT JOIN t ON {match}""")


add("weekday_totals", *cycle("events", "event_type", "dayofweek(ts)", "value", fixed.WEEKDAYS, 0))
add("month_totals", F, *cycle("f", "region", "month(order_date)", "revenue", fixed.MONTHS, 1))
add("month_totals_one_month", *cycle("events", "", "month(ts)", "value", fixed.MONTHS, 1))

# --- breakdowns --------------------------------------------------------------


def breakdown(label: str, by: str) -> str:
    lead, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""SELECT {lead}label, {hu('s', 2)} AS value, n, {hu(f'CASE WHEN t <> 0 THEN s / t ELSE 0 END * 100', 1)} AS pct FROM (
  SELECT *, sum(s) OVER ({part}) AS t FROM (SELECT {lead}CAST({label} AS VARCHAR) AS label, sum(CAST(revenue AS DECIMAL(38,4)))::DOUBLE AS s, count(*) AS n FROM f GROUP BY ALL))"""


def ranked(label: str, by: str) -> str:
    lead, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""tops AS (SELECT *, row_number() OVER ({part}ORDER BY value DESC, label) AS position,
  sum(value) OVER ({part}) AS total FROM (
  SELECT {lead}CAST({label} AS VARCHAR) AS label, {hu('sum(CAST(revenue AS DECIMAL(38,4)))::DOUBLE', 2)} AS value FROM f GROUP BY ALL))"""


add("breakdown", F, breakdown("brand", ""))
add("breakdown_by_region", F, breakdown("product", "region"))
add("top_categories", F, ranked("brand", ""), "SELECT label, value, position FROM tops WHERE position <= 8")
add("top_customers_by_region", F, ranked("customer_id", "region"), "SELECT region, label, value, position FROM tops WHERE position <= 8")


def concentration(by: str) -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}position, label, value, {hu('value / total * 100', 1)} AS pct FROM (
  SELECT {lead}position, label, value, total FROM tops WHERE position <= 5
  UNION ALL SELECT {lead}6, 'Other', {hu('any_value(total) - sum(value) FILTER (position <= 5)', 2)}, any_value(total) FROM tops {'GROUP BY ' + by if by else ''})
WHERE value > 0 OR label <> 'Other'"""


add("concentration", F, ranked("brand", ""), concentration(""))
add("concentration_by_region", F, ranked("customer_id", "region"), concentration("region"))


def histogram(measure: str, by: str) -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    join = f"USING ({by})" if by else "ON true"
    match = f"c.bin = b.bin AND c.{by} = b.{by}" if by else "c.bin = b.bin"
    pick = f"b.{by}, " if by else ""
    return f"""SELECT {pick}{big('b.bin')} AS bin, {hu('lo + b.bin * w')} AS from_value, {hu('lo + (b.bin + 1) * w')} AS to_value,
  coalesce(c.n, 0) AS n FROM (SELECT * FROM g, range(6) AS x(bin)) b
LEFT JOIN (SELECT {lead}greatest(0, least(5, CAST(floor(({measure} - lo) / w) AS INT))) AS bin, count(*) AS n FROM f JOIN g {join} GROUP BY ALL) c
ON {match}""", f"""g AS (SELECT {lead}min({measure}) AS lo,
  (CASE WHEN max({measure}) > min({measure}) THEN max({measure}) - min({measure}) ELSE 1 END) / 6 AS w FROM f {group} HAVING count(*) >= 8)"""


_body, _cte = histogram("revenue", "")
add("histogram", F, _cte, _body)
_body, _cte = histogram("units", "product")
add("histogram_by_product", F, _cte, _body)
add("recent_periods", F, series("region"), """SELECT region, month, value, n, age FROM (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY month DESC) AS age FROM s) WHERE age <= 12""")
add("same_month_across_years", F, series("region"), f"""SELECT region, {big('year(month)')} AS year, value, n FROM s WHERE month(month) = 3
UNION ALL SELECT region, NULL, {hu('sum(value)', 2)}, {big('sum(n)')} FROM s WHERE month(month) = 3 GROUP BY region""")

# --- series models -----------------------------------------------------------


def shape(by: str = "") -> str:
    """Per-key facts of the series ``s`` as ``sh``; Holt by recursion."""
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    on = f"h.{by} = i.{by} AND " if by else ""
    pick = f"h.{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""i AS (SELECT *, row_number() OVER ({part}ORDER BY month) - 1 AS x, count(*) OVER ({part}) AS cnt FROM s),
starts AS (SELECT {lead}max(value) FILTER (x = 0) AS v0, max(value) FILTER (x = 1) AS v1 FROM i {group}),
h AS (SELECT {lead}0::BIGINT AS x, v0 AS lvl, v1 - v0 AS trd FROM starts WHERE v1 IS NOT NULL
  UNION ALL SELECT {pick}i.x, 0.4e0*i.value + 0.6e0*(h.lvl + h.trd),
    0.3e0*((0.4e0*i.value + 0.6e0*(h.lvl + h.trd)) - h.lvl) + 0.7e0*h.trd
  FROM h JOIN i ON {on}i.x = h.x + 1),
hl AS (SELECT {lead}{hu('lvl + trd')} AS holt FROM (SELECT *, row_number() OVER ({part}ORDER BY x DESC) AS z FROM h) WHERE z = 1),
sh0 AS (SELECT {lead}count(*) AS periods, sum(value) AS total, avg(value) AS mean, stddev_pop(value) AS sd,
    max(value) FILTER (x = 0) AS first_value, max(value) FILTER (x = cnt - 1) AS last_value, max(month) AS last_month,
    CASE WHEN count(*) > 1 THEN regr_slope(value, x) ELSE 0 END AS slope,
    CASE WHEN count(*) > 1 THEN regr_intercept(value, x) ELSE 0 END AS intercept,
    avg(value) FILTER (x >= cnt - 3) AS recent FROM i {group}),
sh AS (SELECT sh0.*, coalesce(hl.holt, first_value) AS holt,
    CASE WHEN periods < 2 OR mean = 0 THEN 0 ELSE sd / abs(mean) END AS cv FROM sh0 LEFT JOIN hl {using})"""


def trend(by: str, scenarios: str = "('base', 1e0)", source: str = "sh", extra: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}scenario, {extra}month, {hu('b')} AS value, {hu('b - b*0.12e0')} AS low, {hu('b + b*0.12e0')} AS high FROM (
  SELECT *, CAST(last_month + to_months(CAST(k + 1 AS INT)) AS DATE) AS month,
    CASE WHEN periods < 2 THEN 0 ELSE greatest(0, (intercept + slope * (periods + k)) * factor) END AS b
  FROM {source}, range(6) AS r(k), (VALUES {scenarios}) AS sc(scenario, factor))"""


add("forecast_linear", F, series("region"), shape("region"), trend("region"))
add("forecast_scenarios", F, series(), shape(), trend("", "('base', 1e0), ('optimistic', 1.15e0), ('conservative', 0.85e0)"))
add("history_and_forecast", F, series(), shape(), f"""SELECT month, value AS historical, CAST(NULL AS DOUBLE) AS forecast FROM s
UNION ALL SELECT month, NULL, value FROM ({trend('')})""")
_last = "(CASE WHEN last_value <> 0 THEN last_value ELSE 1 END)"
_trend_pct = f"CASE WHEN periods >= 2 THEN {hu(f'slope / {_last} * 100', 1)} ELSE 0 END"
_next = f"CASE WHEN periods >= 2 THEN greatest({hu('greatest(0, intercept + slope * periods)')}, holt) ELSE 0 END"
add("forecast_outlook", F, series("product"), shape("product"),
    f"SELECT product, periods, {_trend_pct} AS trend_pct, holt, {_next} AS next_value FROM sh")
add("moving_average", F, series("region"), shape("region"), f"""SELECT region, CAST(last_month + to_months(CAST(k + 1 AS INT)) AS DATE) AS month,
  {hu('recent')} AS value, {hu('recent * 0.9e0')} AS low, {hu('recent * 1.1e0')} AS high FROM sh, range(6) AS r(k)""")


def chosen(by: str) -> str:
    return f"""cyc AS (SELECT {by}, count(*) AS nm, var_pop(t) AS vm FROM (
    SELECT {by}, month(month) AS m, {hu('sum(value)', 2)} AS t FROM s GROUP BY ALL) WHERE t > 0 GROUP BY {by}),
whole AS (SELECT {by}, var_pop(value) AS v FROM s GROUP BY {by}),
strength AS (SELECT {by}, CASE WHEN nm >= 6 AND v > 0 THEN least(1e0, vm / v) ELSE 0 END AS seasonality
  FROM whole LEFT JOIN cyc USING ({by})),
cand AS (SELECT {by}, unnest([
    {{'score': CASE WHEN periods >= 12 AND cv < 0.8 THEN 0.85e0 WHEN periods >= 8 THEN 0.6e0 ELSE 0.3e0 END, 'o': 0, 'model': 'holt_linear'}},
    {{'score': CASE WHEN periods < 12 THEN 0.8e0 WHEN cv > 0.6 THEN 0.65e0 ELSE 0.4e0 END, 'o': 1, 'model': 'moving_average'}},
    {{'score': CASE WHEN seasonality > 0.5 AND periods >= 18 THEN 0.9e0 WHEN seasonality > 0.3 THEN 0.6e0 ELSE 0.2e0 END, 'o': 2, 'model': 'seasonal_naive'}},
    {{'score': CASE WHEN cv < 0.4 AND periods >= 10 THEN 0.75e0 ELSE 0.35e0 END, 'o': 3, 'model': 'linear_trend'}}]) AS c
  FROM sh JOIN strength USING ({by})),
ordered AS (SELECT {by}, c.model AS model, c.score AS score, row_number() OVER (PARTITION BY {by} ORDER BY c.score DESC, c.o) AS k FROM cand),
choice AS (SELECT {by}, max(model) FILTER (k = 1) AS chosen_model, max(score) FILTER (k = 1) AS confidence,
  string_agg(model, ',' ORDER BY k) FILTER (k > 1) AS alternatives FROM ordered GROUP BY {by}),
shc AS (SELECT * FROM sh JOIN strength USING ({by}) JOIN choice USING ({by}))"""


add("forecast_model", F, series("region"), shape("region"), chosen("region"), f"""SELECT region, chosen_model,
  CASE WHEN chosen_model = 'moving_average' THEN chosen_model ELSE 'linear_trend' END AS executed_model, confidence, alternatives,
  {hu('seasonality', 2)} AS seasonality, {hu('cv', 2)} AS volatility, periods FROM shc""")
add("forecast_per_customer", F, series("customer_id"), shape("customer_id"), chosen("customer_id"), f"""SELECT customer_id, scenario, chosen_model, month,
  CASE WHEN avgd THEN {hu('recent')} ELSE value END AS value, CASE WHEN avgd THEN {hu('recent * 0.9e0')} ELSE low END AS low,
  CASE WHEN avgd THEN {hu('recent * 1.1e0')} ELSE high END AS high
FROM ({trend('customer_id', source='shc', extra="chosen_model, recent, chosen_model = 'moving_average' AS avgd, ")})""")


def zscores(by: str) -> str:
    return f"""z AS (SELECT *, CASE WHEN sd <> 0 THEN (value - mean) / sd ELSE 0 END AS zs FROM (
  SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, count(*) OVER w AS c FROM s WINDOW w AS (PARTITION BY {by})) WHERE c >= 3),
anom AS (SELECT {by}, month, {hu('value')} AS actual, {hu('mean')} AS expected, {hu('zs', 1)} AS z_score, abs(zs) > 1.8 AS is_anomaly FROM z)"""


add("anomalies", F, series("region"), zscores("region"), "SELECT * FROM anom")
add("flagged_periods", F, series("product"), zscores("product"), "SELECT * EXCLUDE (is_anomaly) FROM anom WHERE is_anomaly")
add("anomaly_model", F, series("customer_id"), shape("customer_id"), """SELECT customer_id,
  CASE WHEN periods < 20 OR cv > 0.8 THEN 'iqr' ELSE 'z_score' END AS chosen_model, 'z_score' AS executed_model,
  CASE WHEN periods < 20 THEN 0.78e0 WHEN cv > 0.8 THEN 0.72e0 ELSE 0.84e0 END AS confidence,
  CASE WHEN periods < 20 THEN 'z_score,seasonal_residual' WHEN cv > 0.8 THEN 'z_score' ELSE 'iqr' END AS alternatives FROM sh""")

# --- models that run as chosen -----------------------------------------------

FORECASTS = ["holt_linear", "moving_average", "seasonal_naive", "linear_trend", "moving_seasonal"]


def predicted(by: str, ask: str) -> str:
    """``pred``: every model's value for each row of ``ask`` ({by}, o known months, step, target); the series is ``s``."""
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY month) - 1 AS x, count(*) OVER (PARTITION BY {by}) AS cnt FROM s),
begin AS (SELECT {by}, max(value) FILTER (x = 0) AS v0, max(value) FILTER (x = 1) AS v1 FROM num GROUP BY {by}),
states AS (SELECT {by}, 0::BIGINT AS x, v0 AS lvl, v1 - v0 AS trd FROM begin
  UNION ALL SELECT q.{by}, num.x, 0.4e0*num.value + 0.6e0*(q.lvl + q.trd),
    0.3e0*((0.4e0*num.value + 0.6e0*(q.lvl + q.trd)) - q.lvl) + 0.7e0*q.trd
  FROM states q JOIN num ON q.{by} = num.{by} AND num.x = q.x + 1),
ask AS ({ask}),
pred AS (SELECT a.{by}, a.o, a.step, a.target,
    greatest(0, any_value(CASE WHEN a.o < 2 THEN q.lvl ELSE q.lvl + q.trd * (a.step + 1) END)) AS holt_linear,
    avg(p.value) FILTER (p.x >= a.o - 3) AS moving_average,
    coalesce(max_by(p.value, p.x) FILTER (month(p.month) = month(a.target)), avg(p.value) FILTER (p.x >= a.o - 3)) AS seasonal_naive,
    CASE WHEN a.o < 2 THEN 0 ELSE greatest(0, regr_intercept(p.value, p.x) + regr_slope(p.value, p.x) * (a.o + a.step)) END AS linear_trend,
    coalesce(CASE WHEN avg(p.value) <> 0 THEN avg(p.value) FILTER (p.x >= a.o - 12) * avg(p.value) FILTER (month(p.month) = month(a.target)) / avg(p.value) END,
      avg(p.value) FILTER (p.x >= a.o - 3)) AS moving_seasonal
  FROM ask a JOIN num p ON p.{by} = a.{by} AND p.x < a.o JOIN states q ON q.{by} = a.{by} AND q.x = a.o - 1 GROUP BY a.{by}, a.o, a.step, a.target)"""


def ahead(by: str, horizon: int = 6) -> str:
    return f"""SELECT {by}, cnt AS o, k AS step, CAST(month + to_months(CAST(k + 1 AS INT)) AS DATE) AS target
  FROM num, range({horizon}) AS r(k) WHERE x = cnt - 1"""


def executed(by: str, models: str, factor: str = "1e0", scenario: str = "base") -> str:
    """``models`` is a table of {by} and executed_model."""
    pick = " ".join(f"WHEN '{m}' THEN {m}" for m in FORECASTS)
    return f"""SELECT {by}, '{scenario}' AS scenario, executed_model, target AS month, {hu('b')} AS value, {hu('b - b * w')} AS low, {hu('b + b * w')} AS high FROM (
  SELECT *, CASE executed_model {pick} END * CASE WHEN executed_model = 'moving_average' THEN 1e0 ELSE {factor} END AS b,
    CASE WHEN executed_model = 'moving_average' THEN 0.1e0 ELSE 0.12e0 END AS w FROM pred JOIN {models} USING ({by}))"""


def tested(by: str) -> str:
    """``best``: errors over the last six months, each forecast from at least three before it."""
    miss = ", ".join(f"{hu(f'avg(abs({m} - value))', 4)} AS mae_{m}" for m in FORECASTS)
    rank = ", ".join(f"{{'e': mae_{m}, 'o': {i}, 'm': '{m}'}}" for i, m in enumerate(FORECASTS))
    return f"""miss AS (SELECT pred.{by}, {miss} FROM pred JOIN num ON num.{by} = pred.{by} AND num.x = pred.o AND pred.step = 0 GROUP BY pred.{by}),
best AS (SELECT *, CASE WHEN mae_moving_average IS NULL THEN 'moving_average' ELSE list_sort([{rank}])[1].m END AS executed_model
  FROM (SELECT {by}, count(*) AS periods FROM s GROUP BY {by}) LEFT JOIN miss USING ({by}))"""


def origins(by: str) -> str:
    return f"SELECT {by}, x AS o, 0 AS step, month AS target FROM num WHERE x >= 3 AND x >= cnt - 6"


_rules = lambda by: f"(SELECT {by}, chosen_model AS executed_model FROM shc)"
add("forecast_executed", F, series("region"), shape("region"), chosen("region"), predicted("region", ahead("region")), executed("region", _rules("region")))
add("forecast_executed_per_customer", F, series("customer_id"), shape("customer_id"), chosen("customer_id"),
    predicted("customer_id", ahead("customer_id")), executed("customer_id", _rules("customer_id"), "1.15e0", "optimistic"))
add("forecast_seasonal", F, series("product"), predicted("product", ahead("product", 12)),
    executed("product", "(SELECT DISTINCT product, 'moving_seasonal' AS executed_model FROM s)"))
add("forecast_tested", F, series("region"), predicted("region", ahead("region") + " UNION ALL " + origins("region")), tested("region"),
    f"""SELECT t.* FROM ({executed('region', 'best')}) t
  JOIN (SELECT region, max(month) AS newest FROM s GROUP BY region) n ON n.region = t.region AND t.month > n.newest""")
add("tested_models", F, series("product"), predicted("product", origins("product")), tested("product"),
    "SELECT * EXCLUDE (executed_model), executed_model AS tested_model FROM best")


def detected(by: str, model: str) -> tuple[str, str]:
    q = lambda c: f"quantile_cont({c}, 0.25) OVER w AS {c}_a, quantile_cont({c}, 0.5) OVER w AS {c}_b, quantile_cont({c}, 0.75) OVER w AS {c}_c"
    wide = lambda c: f"CASE WHEN {c}_c <> {c}_a THEN ({c} - {c}_b) / ({c}_c - {c}_a) ELSE 0 END"
    odd = lambda c: f"({c} < {c}_a - 1.5e0 * ({c}_c - {c}_a) OR {c} > {c}_c + 1.5e0 * ({c}_c - {c}_a))"
    case = lambda a, b, c: f"CASE executed_model WHEN 'z_score' THEN {a} WHEN 'iqr' THEN {b} ELSE {c} END"
    return f"""d0 AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY month) AS x, count(*) OVER w AS c, avg(value) OVER w AS mean,
    stddev_pop(value) OVER w AS sd, {q('value')} FROM s WINDOW w AS (PARTITION BY {by})),
d1 AS (SELECT a.{by}, a.x, (sum(b.value) + sum(b.value) FILTER (abs(b.x - a.x) <= 5)) / 24 AS t
  FROM d0 a JOIN d0 b ON a.{by} = b.{by} AND abs(b.x - a.x) <= 6 GROUP BY ALL HAVING count(*) = 13),
d2 AS (SELECT d0.*, d1.t, coalesce(d1.t, e.t) AS level FROM d0 LEFT JOIN d1 USING ({by}, x)
  LEFT JOIN d1 e ON e.{by} = d0.{by} AND e.x = CASE WHEN d0.x < 7 THEN 7 ELSE d0.c - 6 END WHERE c >= 3),
d3 AS (SELECT *, coalesce(avg(value - t) OVER (PARTITION BY {by}, month(month)), 0) AS season FROM d2),
d4 AS (SELECT *, level + season - avg(season) OVER (PARTITION BY {by}) AS usual FROM d3),
d5 AS (SELECT *, value - usual AS rest FROM d4),
d6 AS (SELECT *, {q('rest')}, {model} AS executed_model FROM d5 WINDOW w AS (PARTITION BY {by}))""", f"""SELECT {by}, month, executed_model, {hu('value')} AS actual, {hu(case('mean', 'value_b', 'usual'))} AS expected,
  {hu(case('CASE WHEN sd <> 0 THEN (value - mean) / sd ELSE 0 END', wide('value'), wide('rest')), 1)} AS score,
  {case('CASE WHEN sd <> 0 THEN abs((value - mean) / sd) > 1.8 ELSE false END', odd('value'), odd('rest'))} AS is_anomaly FROM d6"""


_suited = "CASE WHEN c < 20 OR (mean <> 0 AND sd / abs(mean) > 0.8) THEN 'iqr' ELSE 'z_score' END"
add("anomalies_executed", F, series("region"), *detected("region", _suited))
add("anomalies_executed_per_customer", F, series("customer_id"), *detected("customer_id", _suited))
add("anomalies_by_quartiles", F, series("region"), *detected("region", "'iqr'"))
add("anomalies_seasonal", F, series("region"), *detected("region", "CASE WHEN c >= 24 THEN 'seasonal_residual' ELSE 'iqr' END"))

# --- segments ----------------------------------------------------------------


def segments(by: str = "") -> str:
    lead, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    cuts = ", ".join(
        f"max({m}) FILTER (k_{m} = least(CAST(floor(c * {q}e0) AS BIGINT), c - 1) + 1) AS {m}_{n}"
        for m in ("spend", "orders", "months_active") for n, q in (("lower", 0.33), ("upper", 0.66)))
    return f"""cu0 AS (SELECT {lead}CAST(customer_id AS VARCHAR) AS customer, {hu('sum(CAST(revenue AS DECIMAL(38,4)))::DOUBLE', 2)} AS spend, count(*) AS orders,
    CAST(date_trunc('month', min(order_date)) AS DATE) AS first_month, CAST(date_trunc('month', max(order_date)) AS DATE) AS last_month FROM f GROUP BY {lead}customer_id),
cu AS (SELECT *, {big("greatest(1, date_diff('month', first_month, max(last_month) OVER (" + part + ")))")} AS months_active FROM cu0),
nums AS (SELECT *, count(*) OVER ({part}) AS c, row_number() OVER ({part}ORDER BY spend) AS k_spend,
  row_number() OVER ({part}ORDER BY orders) AS k_orders, row_number() OVER ({part}ORDER BY months_active) AS k_months_active FROM cu),
cuts AS (SELECT {lead}any_value(c) AS n, {cuts} FROM nums {group}),
rfm AS (SELECT *, CASE WHEN months_active <= months_active_lower THEN 3 WHEN months_active <= months_active_upper THEN 2 ELSE 1 END AS r,
  CASE WHEN orders >= orders_upper THEN 3 WHEN orders >= orders_lower THEN 2 ELSE 1 END AS fq,
  CASE WHEN spend >= spend_upper THEN 3 WHEN spend >= spend_lower THEN 2 ELSE 1 END AS mo FROM cu JOIN cuts {using}),
seg AS (SELECT {lead}customer, {hu('spend')} AS monetary, orders AS frequency,
  CASE WHEN r+fq+mo >= 8 THEN 'champion' WHEN r+fq+mo >= 6 THEN 'loyal' WHEN r+fq+mo >= 5 THEN 'atRisk' WHEN r = 1 THEN 'lost' ELSE 'new' END AS segment,
  {big('r+fq+mo')} AS score, spend FROM rfm)"""


add("customer_rollup", F, segments(), "SELECT customer, spend, orders, first_month, last_month, months_active FROM cu")
add("tercile_cuts", F, segments("region"), """SELECT region, metric, n, lower, upper FROM (
  SELECT region, 'spend' AS metric, n, spend_lower AS lower, spend_upper AS upper FROM cuts
  UNION ALL SELECT region, 'orders', n, orders_lower, orders_upper FROM cuts
  UNION ALL SELECT region, 'months_active', n, months_active_lower, months_active_upper FROM cuts)""")
add("customer_segments", F, segments(), "SELECT * EXCLUDE (spend) FROM seg")
add("customer_segments_by_region", F, segments("region"), "SELECT * EXCLUDE (spend) FROM seg")
add("segment_sizes", F, segments("region"), "SELECT region, segment, count(*) AS customers FROM seg GROUP BY ALL")

CHURN = f"""cb AS (SELECT region, count(*) AS customers, sum(spend) AS revenue, count(*) FILTER (frequency > 1) AS repeaters,
    count(*) FILTER (segment IN ('atRisk','lost')) AS at_risk FROM seg GROUP BY region),
cc AS (SELECT cb.*, {hl('repeaters / customers * 100')} AS repeat_rate, CASE WHEN periods > 1 THEN (last_value - first_value)
    / (CASE WHEN first_value <> 0 THEN first_value ELSE 1 END) * 100 ELSE 0 END AS chg,
    CASE WHEN periods > 1 AND mean <> 0 THEN sd / mean ELSE 0 END AS ccv FROM cb LEFT JOIN sh USING (region)),
cs AS (SELECT *, least(100, greatest(0, {hu('''greatest(0, 30 - repeat_rate) + CASE WHEN chg < 0 THEN least(25, -chg) ELSE 0 END
    + CASE WHEN customers < 50 THEN 25 - customers / 2 ELSE 0 END + least(15, ccv * 30)''')})) AS score FROM cc),
churn AS (SELECT region, customers, repeaters, at_risk, repeat_rate, {big('score')} AS churn_score,
  {hu('revenue * (score / 100) * (at_risk / customers) * 0.5 + revenue * (score / 100) * 0.1')} AS revenue_at_risk FROM cs)"""
_SEG = (F, series("region"), shape("region"), segments("region"), CHURN)
add("churn_exposure", *_SEG, "SELECT * FROM churn")

# --- retail ------------------------------------------------------------------

_fields = ", ".join(
    f"('{field}', {i}, '{word}')" for field, words in fixed.RETAIL_COLUMNS.items() for i, word in enumerate(words))
_catalog = " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, {i} AS position, '{c}' AS column_name" for d, cs in W_COLUMNS.items() for i, c in enumerate(cs))
add("retail_columns", f"catalog AS ({_catalog})", f"words(field, priority, word) AS (VALUES {_fields})",
    """SELECT dataset, field, column_name FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, field ORDER BY priority, position) AS k
  FROM catalog JOIN words ON contains(lower(column_name), word)) WHERE k = 1""")
L = """l AS (SELECT * FROM (SELECT *, price * units AS line_revenue FROM f) WHERE line_revenue > 0)"""
add("sales_totals", F, L, f"""SELECT region, {hu('sum(line_revenue)')} AS revenue, count(*) AS orders,
  {hu('sum(line_revenue) / count(*)', 2)} AS average_order FROM l GROUP BY region""")


def buckets(x: str, edges: list[int], source: str, by: str = "") -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    lows, highs = [None, *edges], [*edges, None]
    parts = []
    for i, (low, high) in enumerate(zip(lows, highs)):
        test = " AND ".join(t for t in (f"{x} >= {low}" if low else "", f"{x} < {high}" if high else "") if t)
        parts.append(f"SELECT {lead}{i + 1}::BIGINT AS bucket, CAST({low or 'NULL'} AS DOUBLE) AS from_value, "
                     f"CAST({high or 'NULL'} AS DOUBLE) AS below_value, count(*) FILTER ({test}) AS n FROM {source} {group}")
    return " UNION ALL ".join(parts)


add("order_value_buckets", buckets("value", fixed.ORDER_VALUE_EDGES, "(SELECT * FROM events WHERE value > 0)", "event_type"))
SP = f"""sp AS (SELECT region, CAST(customer_id AS VARCHAR) AS customer, {hu('sum(line_revenue)', 2)} AS spend, count(*) AS orders,
  CAST(date_trunc('month', min(order_date)) AS DATE) AS first_month FROM l GROUP BY region, customer_id)"""
add("customer_spend", F, L, SP, "SELECT customer, spend, orders, first_month FROM sp")
add("lifetime_value_buckets", buckets("spend", fixed.LIFETIME_VALUE_EDGES,
    f"(SELECT user_id, {hu('sum(CAST(value AS DECIMAL(38,4)))::DOUBLE', 2)} AS spend FROM events WHERE value > 0 GROUP BY user_id)"))
add("new_customers_per_month", F, L, SP, "SELECT region, first_month AS month, count(*) AS customers FROM sp GROUP BY ALL")
add("customer_counts", F, L, SP, f"""SELECT region, count(*) AS unique_customers, count(*) FILTER (orders > 1) AS repeat_customers,
  count(*) FILTER (orders <= 1) AS new_customers, {hl('count(*) FILTER (orders > 1) / count(*) * 100')} AS repeat_rate FROM sp GROUP BY region""")
add("fill_rates", R, " UNION ALL ".join(
    f"SELECT {i + 1}::BIGINT AS position, '{c}' AS column_name, {hl(f'count(*) FILTER (NOT {missing(c)}) / count(*) * 100')} AS pct FROM r"
    for i, c in enumerate(R_COLUMNS)))
_first = "(CASE WHEN first_value <> 0 THEN first_value ELSE 1 END)"
add("retail_growth", F, series("region"), shape("region"), f"""SELECT region,
  CASE WHEN periods > 1 AND last_value <> 0 THEN {hl('slope / last_value * 100')} ELSE 0 END AS growth_rate,
  CASE WHEN periods > 1 THEN {hu(f'(last_value - first_value) / {_first} * 100', 1)} ELSE 0 END AS revenue_change FROM sh""")
add("forecast_total", F, series("region"), shape("region"), f"""SELECT region, sum(value) AS forecast_total,
  greatest(arg_min(value, month), any_value(holt)) AS next_month FROM ({trend('region')}) JOIN (SELECT region, holt FROM sh) USING (region) GROUP BY region""")
add("shortfall_at_risk", *_SEG, zscores("region"), f"""SELECT region, {hu('coalesce(gap, 0) + total * churn_score / 100 * 0.15e0')} AS revenue_at_risk
FROM churn JOIN sh USING (region) LEFT JOIN (SELECT region, sum(CASE WHEN is_anomaly AND actual < expected THEN expected - actual ELSE 0 END) AS gap
  FROM anom GROUP BY region) USING (region)""")
_retail_trend = f"CASE WHEN periods > 1 THEN least(25, greatest(0, 12 + (last_value - first_value) / {_first} * 25)) ELSE 12 END"
_stability = f"CASE WHEN periods > 2 THEN least(25, greatest(0, {hu('25 - (CASE WHEN mean <> 0 THEN sd / mean ELSE 0 END) * 30')})) ELSE 15 END"
add("retail_health", F, series("region"), shape("region"),
    f"rc AS (SELECT region, count(*) AS customers, sum(o) AS orders FROM (SELECT region, customer_id, count(*) AS o FROM f GROUP BY ALL) GROUP BY region)",
    f"rh AS (SELECT *, {_retail_trend} AS t, least(25, {hu('customers / orders * 80')}) AS c, {hu('100 * 0.25e0')} AS q, {_stability} AS st FROM sh JOIN rc USING (region))",
    f"SELECT region, {hl('t')} AS trend, {big('c')} AS customer, {big('q')} AS quality, {big('st')} AS stability, {big('least(100, greatest(0, ' + hu('t + c + q + st') + '))')} AS total FROM rh")
add("dependency_risk", F, L, f"""SELECT customer_id, product, {hl('share')} AS share_pct, CASE WHEN share > 50 THEN 'high' ELSE 'medium' END AS level FROM (
  SELECT *, s / sum(s) OVER (PARTITION BY customer_id) * 100 AS share, row_number() OVER (PARTITION BY customer_id ORDER BY s DESC, product) AS k
  FROM (SELECT customer_id, product, sum(line_revenue) AS s FROM l GROUP BY ALL)) WHERE k = 1 AND share > 30""")
add("small_base_actions", f"""sb AS (SELECT event_type, {hu('sum(CAST(value AS DECIMAL(38,4)))::DOUBLE / count(*)', 2)} AS average_order, count(DISTINCT user_id) AS customers
  FROM events WHERE value > 0 GROUP BY event_type)""", """SELECT event_type, 'raise_average_order' AS action, average_order AS evidence FROM sb WHERE average_order < 100
UNION ALL SELECT event_type, 'loyalty_programme', CAST(customers AS DOUBLE) FROM sb WHERE customers BETWEEN 1 AND 99""")

# --- scorecards --------------------------------------------------------------

SCORE = 84
FACTS = f"""conc AS (SELECT region, arg_min(label, (-s, label)) AS top_label, max(s) / sum(s) * 100 AS top_share FROM (
    SELECT region, product AS label, sum(CAST(revenue AS DECIMAL(38,4)))::DOUBLE AS s FROM f GROUP BY ALL) GROUP BY region HAVING sum(s) > 0),
drp AS (SELECT region, count(*) FILTER (is_anomaly AND actual < expected) AS drops FROM anom GROUP BY region),
fx AS (SELECT region, periods, total, first_value, last_value, mean, sd, chosen_model, confidence,
    CASE WHEN chosen_model = 'moving_average' THEN 0 ELSE {_trend_pct} END AS trend_pct,
    CASE WHEN chosen_model = 'moving_average' THEN {hu('recent')} ELSE {_next} END AS next_value,
    drops, customers, repeaters, at_risk, repeat_rate, churn_score, revenue_at_risk, top_label, top_share, {SCORE}::BIGINT AS quality_score,
    CASE WHEN mean <> 0 THEN sd / mean ELSE 0 END AS vcv
  FROM shc LEFT JOIN drp USING (region) LEFT JOIN churn USING (region) LEFT JOIN conc USING (region))"""
_FX = (*_SEG, chosen("region"), zscores("region"), FACTS)
add("entity_facts", *_FX, f"""SELECT region, periods, {hu('total', 2)} AS total, first_value, last_value, chosen_model, confidence, trend_pct, next_value,
  drops, customers, repeaters, at_risk, repeat_rate, churn_score, revenue_at_risk, top_label, {hu('top_share', 2)} AS top_share, quality_score FROM fx""")
HEALTH = f"""hp AS (SELECT region, {_retail_trend} AS t, least(25, {hu('repeaters / customers * 25')} + 5) AS c,
    {hu('quality_score / 100 * 25')} AS q, CASE WHEN periods > 2 THEN least(25, greatest(0, {hu('25 - vcv * 30')})) ELSE 15 END AS st,
    quality_score, confidence FROM fx),
health AS (SELECT region, {hl('t')} AS trend, {big('c')} AS customer, {big('q')} AS quality, {big('st')} AS stability,
    {big('least(100, greatest(0, ' + hu('t + c + q + st') + '))')} AS total, quality_score, confidence FROM hp)"""
add("health_by_region", *_FX, HEALTH, """SELECT region, trend, customer, quality, stability, total,
  CASE WHEN total >= 80 THEN 'strong' WHEN total >= 60 THEN 'watch' ELSE 'critical' END AS health_band,
  'review' AS quality_card, 'ready' AS quality_overview FROM health""")


def risk(order: int, name: str, level: str, evidence: str, present: str) -> str:
    return (f"SELECT region, {order} AS o, '{name}' AS risk, {level} AS level, CAST({evidence} AS DOUBLE) AS evidence "
            f"FROM fx WHERE {present}")


RISKS = "rk0 AS (" + " UNION ALL ".join([
    risk(0, "concentration", "CASE WHEN top_share > 60 THEN 'high' WHEN top_share > 40 THEN 'medium' ELSE 'low' END", hu("top_share"), "top_share IS NOT NULL"),
    risk(1, "volatility", "CASE WHEN vcv > 0.4 THEN 'high' WHEN vcv > 0.2 THEN 'medium' ELSE 'low' END", hu("vcv * 100"), "periods > 2"),
    risk(2, "customer_base", "CASE WHEN customers < 20 THEN 'high' WHEN customers < 50 THEN 'medium' ELSE 'low' END", "customers", "customers IS NOT NULL"),
    risk(3, "churn", "CASE WHEN churn_score >= 60 THEN 'high' ELSE 'medium' END", "churn_score", "churn_score >= 35"),
    risk(4, "shortfall", "'medium'", "drops", "drops >= 2"),
    risk(5, "data_quality", "CASE WHEN quality_score < 70 THEN 'high' ELSE 'medium' END", "quality_score", "quality_score < 88"),
]) + """),
risks AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY list_position(['high','medium','low'], level), o) AS position FROM rk0)"""
add("risks_by_region", *_FX, RISKS, "SELECT region, position, risk, level, evidence FROM risks")

# Rule number, action, impact, value, low, high, effort, days, floor, related risks, fires when.
_growth = f"(last_value - first_value) / {_first} * 100"
_exposed = "(CASE WHEN revenue_at_risk <> 0 THEN revenue_at_risk ELSE total * 0.15e0 END)"
_measure = "concentration,volatility,shortfall"
_ACTIONS = [
    (1, "reduce_concentration", "high", f"total * ({hu('top_share')} / 100)", .7, 1.3, "medium", 7, "immediate", _measure, "top_share > 60"),
    (2, "accelerate_growth", "high", "total * 0.12e0", .6, 1.5, "high", 14, "this_month", _measure + ",churn:high", f"periods > 1 AND {_growth} < 5"),
    (3, "validate_near_term_growth", "high", "total * 0.12e0", .6, 1.5, "medium", 5, "this_month", _measure, "periods >= 6 AND next_value > last_value * 1.1"),
    (4, "re_engage_customers", "high", _exposed, .5, 1.2, "medium", 5, "this_month", "customer_base,churn", "at_risk > 0"),
    (5, "prevent_churn", "medium", _exposed, .5, 1.2, "medium", 7, "immediate", "volatility:high,customer_base,churn", "churn_score >= 40"),
    (6, "build_loyalty", "medium", _exposed, .5, 1.2, "medium", 5, "this_quarter", "customer_base,churn", "customers > 0 AND customers < 100"),
    (7, "improve_data", "medium", None, 0, 0, "medium", 7, "this_quarter", "data_quality", "quality_score < 80"),
    (9, "review_periodically", "medium", None, 0, 0, "low", 1, "this_quarter", "data_quality", "true"),
]
_RANK = {"concentration": 0, "volatility": 1, "customer_base": 2, "churn": 3, "shortfall": 4, "data_quality": 5}


def action(rule, name, impact, value, low, high, effort, days, floor, related, when, quality) -> str:
    v = value or "total * 0.05e0"
    lo = f"({v}) * {low}e0" if value else "total * 0.02e0"
    hi = f"({v}) * {high}e0" if value else "total * 0.08e0"
    column_quality = {
        1: f"({quality['category']}e0 + {quality['measure']}e0) / 2 / 100", 2: f"{quality['measure']}e0 / 100",
        3: f"{quality['measure']}e0 / 100", 4: "80e0 / 100", 5: "80e0 / 100", 6: "80e0 / 100"}.get(rule, "0.75e0")
    tests = " OR ".join(
        f"(k.risk = '{r.split(':')[0]}'" + (f" AND k.level = '{r.split(':')[1]}'" if ":" in r else "") + ")" for r in related.split(","))
    rel = f"(SELECT coalesce(string_agg(k.risk, ',' ORDER BY k.o), '') FROM rk0 k WHERE k.region = fx.region AND ({tests}))"
    top = f"(SELECT min(list_position(['high','medium','low'], k.level)) FROM rk0 k WHERE k.region = fx.region AND ({tests}))"
    return (f"SELECT region, {rule}::BIGINT AS rule, '{name}' AS action, '{impact}' AS impact, {hu(v)} AS value, {hu(lo)} AS value_low, "
            f"{hu(hi)} AS value_high, '{effort}' AS effort, {days}::BIGINT AS days, '{floor}' AS fl, {top} AS top, {rel} AS related_risks, "
            f"{hu(f'least(0.95e0, quality_score / 100 * 0.6e0 + {column_quality} * 0.4e0)', 2)} AS confidence FROM fx WHERE {when}")


def actions(quality: dict) -> str:
    union = " UNION ALL ".join(action(*a, quality) for a in _ACTIONS)
    return f"""fired AS ({union}),
kept AS (SELECT *, CASE WHEN top = 1 OR fl = 'immediate' THEN 'immediate' WHEN top = 2 OR fl = 'this_month' THEN 'this_month' ELSE 'this_quarter' END AS urgency
  FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY rule) AS nth FROM fired)),
valued AS (SELECT *, {big('least(100, greatest(5, ' + hu('''log10(value + 100) * 10 * confidence
    * (CASE urgency WHEN 'immediate' THEN 1.3e0 WHEN 'this_month' THEN 1.1e0 ELSE 1e0 END) * 10
    / (CASE effort WHEN 'low' THEN 1e0 WHEN 'medium' THEN 2.5e0 ELSE 5e0 END)''') + '))')} AS priority FROM kept),
acts AS (SELECT region, rule, action, impact, value, value_low, value_high, urgency, effort, days, confidence, related_risks, priority,
  row_number() OVER (PARTITION BY region ORDER BY priority DESC, rule) AS position FROM valued)"""


add("actions_by_region", *_FX, RISKS, actions({"category": 90, "measure": 95}), "SELECT * FROM acts")
add("action_totals", *_FX, RISKS, actions({"category": 80, "measure": 80}), f"""SELECT region,
  {hu("sum(CASE WHEN related_risks <> '' THEN value ELSE 0 END)")} AS value_at_risk,
  {hu("sum(CASE WHEN action IN ('accelerate_growth','validate_near_term_growth','re_engage_customers') THEN value ELSE 0 END)")} AS opportunity
FROM acts GROUP BY region""")
add("alerts_by_region", *_FX, RISKS, HEALTH, """SELECT region, 'health_below' AS alert, CAST(total AS DOUBLE) AS value, 99e0 AS threshold FROM health WHERE total < 99
UNION ALL SELECT region, 'quality_below', CAST(quality_score AS DOUBLE), 90e0 FROM health WHERE quality_score < 90
UNION ALL SELECT region, 'revenue_movement', CAST(count(*) AS DOUBLE), NULL FROM risks WHERE risk IN ('volatility','shortfall') AND level <> 'low' GROUP BY region""")
TARGETS = f"""tg AS (SELECT region, 'health' AS metric, CAST(total AS DOUBLE) AS current, least(100e0, greatest(75e0, total + 10e0)) AS target FROM health
  UNION ALL SELECT region, 'quality', CAST(quality_score AS DOUBLE), least(100e0, greatest(90e0, quality_score + 5e0)) FROM health
  UNION ALL SELECT region, 'trend', CAST(trend AS DOUBLE), 12e0 FROM health
  UNION ALL SELECT region, 'confidence', {hu('confidence * 100')}, least(100e0, greatest(80e0, {hu('confidence * 100')} + 8)) FROM health),
att AS (SELECT *, {hu('least(100, greatest(0, current / target * 100))', 1)} AS progress, current >= target AS achieved FROM tg)"""
add("targets_by_region", *_FX, HEALTH, TARGETS, "SELECT * FROM att")
add("target_summary", *_FX, HEALTH, TARGETS, f"""SELECT region, count(*) FILTER (achieved) AS achieved, count(*) AS targets,
  {hu('avg(progress)')} AS progress FROM att GROUP BY region""")


def scenarios(by: str, cost: str, levers: str) -> str:
    revenue = "rv * (1 + p / 100) * (1 + v / 100) * (1 + t / 100 * 0.35e0)"
    spent = "cs * (1 + v / 100) * (1 + c / 100)"
    return f"""SELECT {by}, p AS price_pct, v AS volume_pct, c AS unit_cost_pct, t AS retention_pct, {hu(revenue, 2)} AS revenue, {hu(spent, 2)} AS cost,
  {hu(f'{revenue} - {spent}', 2)} AS profit, {hu(f'({revenue} - {spent}) - (rv - cs)', 2)} AS profit_change
FROM (SELECT {by}, sum(CAST(revenue AS DECIMAL(38,4)))::DOUBLE AS rv, {cost} AS cs FROM f GROUP BY {by}), {levers}"""


add("scenario_grid", F, scenarios("region", "sum(CAST(cost AS DECIMAL(38,4)))::DOUBLE",
    "(VALUES (-10e0), (0e0), (10e0)) a(p), (VALUES (0e0), (20e0)) b(v), (VALUES (0e0), (5e0)) d(c), (VALUES (0e0), (15e0)) e(t)"))
add("scenario_default_cost", F, scenarios("product", "sum(CAST(revenue AS DECIMAL(38,4)))::DOUBLE * 0.55e0", "(VALUES (5e0, 10e0, 0e0, 10e0)) a(p, v, c, t)"))
add("outcome_totals", f"""SELECT o_orderpriority, {hu('sum(CAST(o_totalprice AS DECIMAL(38,4)))::DOUBLE', 2)} AS expected,
  {hu("sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END)", 2)} AS actual,
  count(*) FILTER (o_orderstatus = 'F') AS validated, count(*) AS decisions FROM orders GROUP BY o_orderpriority""")
add("latest_events", "SELECT event_id, event_type, value FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 250")
add("latest_events_of_type", """SELECT event_id, user_id, value FROM events WHERE user_id % 2 = 1 AND event_type = 'purchase'
ORDER BY ts DESC, event_id DESC LIMIT 40""")
add("all_events_of_type", "SELECT event_id, value FROM events WHERE user_id = 7 AND event_type = 'purchase'")
add("event_types", "SELECT DISTINCT event_type FROM events WHERE user_id = 7")

# --- linkage -----------------------------------------------------------------

_order = ", ".join(f"'{name}'" for name in W_COLUMNS)
_purpose = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(dataset), '{words}') OR {test} THEN '{name}'"
    for (name, words), test in zip(fixed.PURPOSE_WORDS, [
        "has_inventory", "(has_customer AND NOT has_revenue)", "(has_product AND NOT has_date)",
        "(has_cost AND NOT has_revenue)", "(has_revenue AND has_date)"])) + " ELSE 'operations' END"
PURPOSES = f"""has AS (SELECT dataset, max(rows) AS rows, {', '.join(f"bool_or(role = '{r}') AS has_{r}" for r in
    ('inventory', 'customer', 'revenue', 'product', 'date', 'cost'))} FROM roles GROUP BY dataset),
purposes AS (SELECT dataset, rows, {_purpose} AS purpose FROM has)"""
add("table_purposes", *_CR0, PURPOSES, "SELECT dataset, purpose FROM purposes")
add("primary_table", *_CR0, PURPOSES, """SELECT dataset, purpose, rows FROM purposes
  ORDER BY purpose <> 'sales', CASE WHEN purpose = 'sales' THEN 0 ELSE -rows END, dataset LIMIT 1""")
_link_roles = listed(fixed.LINK_ROLES)
LINKS = f"""cat AS (SELECT *, row_number() OVER (ORDER BY list_position([{_order}], dataset), position) AS i,
    list_position([{_order}], dataset) AS d, regexp_replace(lower(column_name), '[^a-z0-9]', '', 'g') AS plain FROM roles),
pair AS (SELECT a.dataset AS left_dataset, a.column_name AS left_column, b.dataset AS right_dataset, b.column_name AS right_column,
    a.role AS left_role, a.i AS ai, b.i AS bi, a.plain = b.plain AS same_name, a.role = b.role AND a.role IN ({_link_roles}) AS same_role
  FROM cat a JOIN cat b ON a.d < b.d WHERE (a.role IN ({_link_roles}) OR b.role IN ({_link_roles}))
    AND (a.plain = b.plain OR (a.role = b.role AND a.role IN ({_link_roles})))),
keys AS (SELECT DISTINCT dataset, column_name, lower(trim(raw)) AS k FROM cells WHERE trim(raw) <> ''),
sizes2 AS (SELECT dataset, column_name, count(*) AS n FROM keys GROUP BY ALL),
lap AS (SELECT p.*, l.n AS left_keys, r.n AS right_keys, (SELECT count(*) FROM keys x JOIN keys y ON x.k = y.k
      WHERE x.dataset = p.left_dataset AND x.column_name = p.left_column AND y.dataset = p.right_dataset AND y.column_name = p.right_column) AS shared_keys
  FROM pair p JOIN sizes2 l ON l.dataset = left_dataset AND l.column_name = left_column
  JOIN sizes2 r ON r.dataset = right_dataset AND r.column_name = right_column),
ov AS (SELECT *, {hu('shared_keys / least(left_keys, right_keys) * 100')} AS overlap_pct FROM lap),
rel0 AS (SELECT *, least(0.99e0, CASE WHEN same_name THEN 0.5e0 ELSE 0e0 END + CASE WHEN same_role THEN 0.24e0 ELSE 0e0 END
    + overlap_pct / 100 * 0.35e0) AS conf FROM ov),
rel AS (SELECT *, {hu('conf', 2)} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY left_dataset, right_dataset
    ORDER BY {hu('conf', 2)} DESC, ai, bi) AS k FROM rel0 WHERE conf >= 0.48))"""
add("key_overlap", *_CR0, LINKS, """SELECT left_keys, right_keys, shared_keys, overlap_pct, left_dataset, left_column, right_dataset, right_column FROM ov""")
add("relations", *_CR0, LINKS, """SELECT left_dataset, left_column, right_dataset, right_column,
  CASE WHEN left_role = 'date' THEN 'period_alignment' ELSE 'shared_key' END AS kind, confidence, overlap_pct, conf >= 0.65 AS confirmed FROM rel""")
COVER = """cov AS (SELECT key, demand, stock, stock < demand AS under_stocked FROM
  (SELECT part_id AS key, sum(CAST(quantity AS DOUBLE)) AS demand FROM w_sales GROUP BY 1)
  JOIN (SELECT part_id AS key, sum(CAST(inventory AS DOUBLE)) AS stock FROM w_inventory GROUP BY 1) USING (key))"""
add("stock_coverage", W, COVER, "SELECT * FROM cov")
COVER_SUM = f"""covs AS (SELECT count(*) AS matched_keys, count(*) FILTER (under_stocked) AS under_stocked,
  CASE WHEN sum(demand) > 0 THEN {hu('sum(stock) / sum(demand) * 100', 4)} ELSE 0 END AS coverage_pct,
  CASE WHEN count(*) = 0 THEN NULL WHEN count(*) FILTER (under_stocked) = 0 THEN 'opportunity'
    WHEN count(*) FILTER (under_stocked) / count(*) >= 0.25 THEN 'high' ELSE 'medium' END AS priority FROM cov)"""
add("coverage_summary", W, COVER, COVER_SUM, "SELECT * FROM covs")
add("unmatched_keys", W, "SELECT DISTINCT customer_id AS key FROM w_customers WHERE customer_id NOT IN (SELECT customer_id FROM w_sales)")
add("unmatched_recent_keys", W, """SELECT DISTINCT customer_id AS key FROM w_customers WHERE customer_id NOT IN (
  SELECT customer_id FROM w_sales WHERE left(order_date, 7) = (SELECT max(left(order_date, 7)) FROM w_sales))""")
CONTRIB = f"""con AS (SELECT {hu('rv', 2)} AS revenue, {hu('cs', 2)} AS cost, {hu('(rv - cs) / rv * 100', 4)} AS contribution_pct FROM (
  SELECT (SELECT sum(CAST(revenue AS DOUBLE)) FROM w_sales) AS rv, (SELECT sum(CAST(cost AS DOUBLE)) FROM w_expenses) AS cs) WHERE rv > 0)"""
add("contribution", W, CONTRIB, "SELECT * FROM con")
_link = "(SELECT {what} FROM rel WHERE left_dataset = 'sales' AND right_dataset = '{other}' ORDER BY confidence DESC, ai, bi LIMIT 1)"
_METRICS = (*_CR0, LINKS, COVER, COVER_SUM, CONTRIB)
_confirmed = "coalesce(" + _link.format(what="conf >= 0.65", other="{o}") + ", false)"
add("connected_metrics", *_METRICS, f"""SELECT 'connected_revenue' AS metric, revenue AS value FROM con
UNION ALL SELECT 'inventory_demand_coverage', {hu('coverage_pct', 2)} FROM covs WHERE {_confirmed.format(o='inventory')}
UNION ALL SELECT 'products_requiring_review', CAST(under_stocked AS DOUBLE) FROM covs WHERE {_confirmed.format(o='inventory')}
UNION ALL SELECT 'customer_linkage', {_link.format(what='overlap_pct', other='customers')} WHERE {_confirmed.format(o='customers')}
UNION ALL SELECT 'cross_source_contribution', {hu('contribution_pct', 2)} FROM con""")
add("connected_insights", *_METRICS, f"""SELECT CASE WHEN priority = 'opportunity' THEN 'inventory_balanced' ELSE 'inventory_review' END AS insight, priority,
  {_link.format(what='confidence', other='inventory')} AS confidence FROM covs WHERE {_link.format(what='true', other='inventory')}
UNION ALL SELECT 'customer_linkage_review', CASE WHEN overlap_pct < 50 THEN 'high' ELSE 'medium' END, confidence FROM rel
  WHERE left_dataset = 'sales' AND right_dataset = 'customers' AND k = 1 AND overlap_pct < 80
UNION ALL SELECT 'finance_reconciliation', 'opportunity', 0.7e0 FROM con""")

# --- streaming ---------------------------------------------------------------

add("monthly_series_without_gaps", F, f"""seen AS (SELECT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS month,
    {hu('sum(CAST(revenue AS DECIMAL(38,4)))::DOUBLE', 2)} AS value, count(*) AS n FROM f GROUP BY ALL),
every AS (SELECT customer_id, CAST(unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month
  FROM seen GROUP BY customer_id)""", """SELECT customer_id, month, coalesce(value, 0) AS value, coalesce(n, 0) AS n
FROM every LEFT JOIN seen USING (customer_id, month)""")
_closed = "CASE WHEN o_orderstatus <> 'O' THEN o_totalprice ELSE 0 END"
add("numeric_summary_blank_as_zero", f"""z AS (SELECT o_orderpriority, {_closed} AS x FROM orders),
q AS (SELECT o_orderpriority, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM z GROUP BY 1)""",
    f"""SELECT o_orderpriority, count(*) AS n, {hu('avg(x)', 2)} AS mean, {hu('quantile_cont(x, 0.5)', 2)} AS median, {hu('any_value(q3)', 2)} AS q3,
  min(x) AS "min", max(x) AS "max", count(*) FILTER (x < q1 - 1.5e0 * (q3 - q1) OR x > q3 + 1.5e0 * (q3 - q1)) AS outliers
FROM z JOIN q USING (o_orderpriority) GROUP BY o_orderpriority""")
add("live_revenue", f"""SELECT CAST(ts AS DATE) AS day, {hu('sum(CAST(value AS DECIMAL(38,4)))::DOUBLE', 2)} AS revenue, count(*) AS orders FROM events GROUP BY 1""")
add("live_customers", f"""SELECT user_id AS customer, {hu('sum(CAST(value AS DECIMAL(38,4)))::DOUBLE', 2)} AS spend, count(*) AS orders,
  CAST(min(ts) AS DATE) AS first_day FROM events GROUP BY user_id""")
