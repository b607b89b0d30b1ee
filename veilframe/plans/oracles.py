"""DuckDB's SQL for the queries."""

from __future__ import annotations

from ..functions import columns as names_of
from ..functions import phi
from ..functions import scalars as s
from . import queries as q
from . import round_trips as rt
from . import spec


def _t(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(xs) -> str:
    return "(" + ", ".join(map(_t, xs)) + ")"


def _values(xs) -> str:
    return ", ".join(f"({i}, {_t(v)})" for i, v in enumerate(xs))


TRIM = r"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


def _trim(v: str) -> str:
    return TRIM.format(v=v)


BUCKET = "CASE " + " ".join(f"WHEN n <= {top} THEN '{name}'" for top, name in s.BUCKETS) + f" ELSE '{s.ABOVE}' END"


def _missing(v: str) -> str:
    return f"({v} IS NULL OR lower({_trim(v)}) IN {_in(s.MISSING)})"


def _boolean(t: str) -> str:
    return f"(lower({t}) IN {_in(s.TRUE + s.FALSE)})"


def _integer(t: str) -> str:
    return f"(regexp_full_match({t}, '[+-]?[0-9]+') AND TRY_CAST({t} AS BIGINT) IS NOT NULL)"


def _numeric(t: str) -> str:
    return rf"regexp_full_match(lower({t}), '[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)')"


_FORMATS = {"yyyy-MM-dd": "%Y-%m-%d", "M/d/yyyy": "%m/%d/%Y", "d-M-yyyy": "%d-%m-%Y", "M/d/yy": "%m/%d/%y", "MMMM d, yyyy": "%B %d, %Y", "MMM d, yyyy": "%b %d, %Y", "yyyy.MM.dd": "%Y.%m.%d"}


def _date(t: str) -> str:
    return "(" + " OR ".join(f"(regexp_full_match({t}, {_t(shape)}) AND coalesce({', '.join(f'try_strptime({t}, {_t(_FORMATS[f])})' for f in formats)}) IS NOT NULL)" for shape, formats in s.DATES) + ")"


def _datetime(t: str) -> str:
    return rf"regexp_full_match({t}, '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(Z|\.\d+)?')"


def _kind(v: str) -> str:
    t, out = _trim(v), []
    for kind, pattern in phi.PATTERNS:
        if kind == "long_id":
            out.append(f"WHEN regexp_full_match({t}, '[A-Za-z0-9]{{10,}}') AND regexp_matches({t}, '[A-Za-z]') AND regexp_matches({t}, '[0-9]') THEN 'long_id'")
        else:
            out.append(f"WHEN regexp_full_match({t}, {_t(pattern)}) THEN '{kind}'")
    return "CASE " + " ".join(out) + " END"


def _listable() -> str:
    return f"n >= 5 AND strlen(value) <= 32 AND ({_kind('value')}) IS NULL AND NOT ({_likely('value')})"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _class(column: str, where: str) -> str:
    """The first word that fits each name of a table expression with column."""
    words = [(kind, w) for kind, ws in (("phi", names_of.PHI), ("recode", names_of.RECODE), ("warning", names_of.WARN)) for w in ws]
    rows = ", ".join(f"({i}, {_t(k)}, {_t(w)}, {_t(names_of.name_regex(w))})" for i, (k, w) in enumerate(words))
    plain = f"regexp_replace(lower({column}), '[- .]', '_', 'g')"
    return f"""(SELECT {column}, coalesce(arg_min(k, i), 'safe') AS classification, arg_min(w, i) AS pattern
      FROM (SELECT DISTINCT {column} FROM {where}) LEFT JOIN (VALUES {rows}) AS words(i, k, w, rx) ON regexp_matches({plain}, rx) GROUP BY {column})"""


def _typed(tables: dict[str, str], sample: int = 2000) -> str:
    """col, dtype of all columns, by the rules as stated: the first values, then each later one."""
    cells = _union(f"SELECT '{t}.{c}' AS col, row_number() OVER () AS r, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cols in tables.items() for c in cols.split())
    t = _trim("v")
    return f"""(WITH cells AS ({cells}),
    filled AS (SELECT col, v, r, row_number() OVER (PARTITION BY col ORDER BY r) AS k FROM cells WHERE NOT {_missing("v")}),
    p AS (SELECT col, k, {_boolean(t)} AS b, {_integer(t)} AS i, {_numeric(t)} AS n, {_date(t)} AS d, {_datetime(t)} AS dt, strlen(v) > {s.LONG_BYTES} OR contains(v, chr(10)) AS l FROM filled),
    start AS (SELECT col, CASE WHEN bool_and(b) THEN 'boolean' WHEN bool_and(i) THEN 'integer' WHEN bool_and(n) THEN 'numeric' WHEN bool_and(dt) THEN 'datetime' WHEN bool_and(d) THEN 'date' ELSE 'string' END AS t0 FROM p WHERE k <= {sample} GROUP BY col),
    later AS (SELECT col, t0, k, b, i, n, d, dt, l, CASE t0 WHEN 'boolean' THEN NOT b WHEN 'integer' THEN NOT n WHEN 'numeric' THEN NOT n WHEN 'string' THEN false ELSE NOT (d OR dt) END AS broken FROM p JOIN start USING (col) WHERE k > {sample}),
    e AS (SELECT col, bool_or(broken) AS broken, min(k) FILTER (broken) AS first_break, bool_or(NOT i) AS frac, bool_or(dt) AS stamp, count(*) FILTER (l) AS longs, max(k) FILTER (l) AS last FROM later GROUP BY col)
    SELECT c.col, CASE WHEN t0 IS NULL THEN 'string' WHEN coalesce(broken, false) OR t0 = 'string' THEN CASE WHEN longs > 10 AND last > coalesce(first_break, 0) THEN 'free_text' ELSE 'string' END
      WHEN t0 = 'integer' AND frac THEN 'numeric' WHEN t0 = 'date' AND stamp THEN 'datetime' ELSE t0 END AS dtype
    FROM (SELECT DISTINCT col FROM cells) c LEFT JOIN start USING (col) LEFT JOIN e USING (col))"""


def _profile() -> str:
    out = []
    for t in ("lineitem", "orders"):
        for c in q.SCHEMAS[t].split():
            out.append(f"SELECT '{t}.{c}' AS col, '{c}' AS name, CAST({c} AS VARCHAR) AS v, TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS x FROM {t}")
    both = {t: q.SCHEMAS[t] for t in ("lineitem", "orders")}
    names = _union(f"SELECT '{c}' AS name" for cols in both.values() for c in cols.split())
    return f"""
WITH cells AS ({_union(out)}),
agg AS (SELECT col, name, round(median(x), 6) AS median, count(*) FILTER (NOT {_missing("v")}) AS non_missing, count(*) FILTER ({_missing("v")}) AS missing, count(DISTINCT v) AS d, min(x) AS low, max(x) AS high, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std_dev FROM cells GROUP BY col, name),
freq AS (SELECT col, v AS value, count(*) AS n FROM cells GROUP BY col, v),
lists AS (SELECT col, count(*) AS listed FROM freq WHERE {_listable()} GROUP BY col),
classes AS {_class("name", f"({names})")},
types AS {_typed(both)}
SELECT a.col, dtype, CASE WHEN d > 2000 AND classification <> 'phi' THEN 'high_cardinality' ELSE classification END AS classification, non_missing, missing, CASE WHEN d <= 2000 THEN d END AS n_distinct,
  CASE WHEN d > 2000 OR classification = 'phi' THEN 0 ELSE coalesce(listed, 0) END AS listed,
  CASE WHEN dtype IN ('integer', 'numeric') AND classification <> 'phi' THEN round(low, 6) END AS low, CASE WHEN dtype IN ('integer', 'numeric') AND classification <> 'phi' THEN round(high, 6) END AS high,
  CASE WHEN dtype IN ('integer', 'numeric') AND classification <> 'phi' THEN mean END AS mean, CASE WHEN dtype IN ('integer', 'numeric') AND classification <> 'phi' THEN std_dev END AS std_dev, CASE WHEN dtype IN ('integer', 'numeric') AND classification <> 'phi' THEN median END AS median
FROM agg a JOIN classes USING (name) JOIN types USING (col) LEFT JOIN lists ON lists.col = a.col
"""


def _label(n: str) -> str:
    out, before = [], 0
    for letters in range(1, 5):
        digits = " || ".join(f"chr(CAST(65 + ({n} - {before}) // {26**k} % 26 AS INTEGER))" for k in reversed(range(letters)))
        out.append(f"WHEN {n} < {before + 26**letters} THEN {digits}")
        before += 26**letters
    return "CASE " + " ".join(out) + " END"


def _anywhere() -> str:
    t, out = _trim("v"), []
    for kind, pattern in spec.ANYWHERE:
        if kind == "long_id":
            out.append("WHEN len(list_filter(regexp_extract_all(v, '[A-Za-z0-9]{10,}'), lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]'))) > 0 THEN 'long_id'")
        else:
            out.append(f"WHEN regexp_matches(v, {_t(pattern)}) THEN '{kind}'")
    return "CASE " + " ".join(out) + f" WHEN {_date(t)} OR {_datetime(t)} THEN 'date' END"


def _likely(v: str) -> str:
    """By the lists, or by the shape."""
    t = f"lower(strip_accents(trim({v})))"
    known = lambda x: f"({x} IN {_in(sorted(set(phi.SURNAMES) | set(phi.FIRST_NAMES)))})"
    word = lambda i: f"split_part({t}, ' ', {i})"
    n = f"len(string_split({t}, ' '))"
    ok = rf"regexp_full_match({word(1)}, '[\pL-]{{2,}}') AND regexp_full_match({word(-1)}, '[\pL-]{{2,}}')"
    first, last = f"{word(1)} IN {_in(phi.FIRST_NAMES)}", f"{word(3)} IN {_in(phi.SURNAMES)}"
    other = f"{word(1)} IN {_in(phi.SURNAMES)} AND {word(3)} IN {_in(phi.FIRST_NAMES)}"
    one = r"(?:\p{Lu}\p{L}*[-''’])*\p{Lu}\p{Ll}+"
    shape = rf"regexp_full_match(trim({v}), '{one}(?: (?:{one}|\p{{Lu}}\.*))? {one}')"
    return f"strlen({t}) >= 2 AND ({known(t)} OR {shape} OR ({n} = 2 AND {ok} AND ({known(word(1))} OR {known(word(2))})) OR ({n} = 3 AND {ok} AND ({first} AND {last} OR {other})))"


def _p2(source: str, p: float = 0.5) -> str:
    """The five markers, a row at a time: source has n (from 1, without gaps) and x."""
    want = (1.0, 1 + 2 * p, 1 + 4 * p, 3 + 2 * p, 5.0)
    speed = (0.0, p / 2, p, (1 + p) / 2, 1.0)
    cols = lambda *skip: ", ".join(c for c in ("n", "q0", "q1", "q2", "q3", "q4", "p1", "p2", "p3", "p4") if c not in skip)
    step = "SELECT v.n AS n, least(q0, x) AS q0, q1, q2, q3, greatest(q4, x) AS q4, p1 + (x < q1)::INT AS p1, p2 + (x < q2)::INT AS p2, p3 + (x < q3)::INT AS p3, p4 + 1 AS p4 FROM st JOIN v ON v.n = st.n + 1"
    for k in (1, 2, 3):
        left = "1" if k == 1 else f"p{k - 1}"
        gap = f"({want[k]!r} + (n - 5) * {speed[k]!r} - p{k})"
        d = f"(CASE WHEN {gap} >= 1 AND p{k + 1} - p{k} > 1 THEN 1 WHEN {gap} <= -1 AND p{k} - {left} > 1 THEN -1 ELSE 0 END)"
        up, down = f"((q{k + 1} - q{k}) / (p{k + 1} - p{k}))", f"((q{k} - q{k - 1}) / (p{k} - {left}))"
        curved = f"(q{k} + d::DOUBLE / (p{k + 1} - {left}) * ((p{k} - {left} + d) * {up} + (p{k + 1} - p{k} - d) * {down}))"
        step = f"SELECT {cols(f'q{k}', f'p{k}')}, CASE WHEN d = 0 THEN q{k} WHEN q{k - 1} < {curved} AND {curved} < q{k + 1} THEN {curved} WHEN d > 0 THEN q{k} + {up} ELSE q{k} - {down} END AS q{k}, p{k} + d AS p{k} FROM (SELECT *, {d} AS d FROM ({step}))"
    return f"""
WITH RECURSIVE v AS ({source}),
five AS (SELECT list(x ORDER BY x) AS l FROM v WHERE n <= 5),
st AS (SELECT 5::BIGINT AS n, l[1] AS q0, l[2] AS q1, l[3] AS q2, l[4] AS q3, l[5] AS q4, 2 AS p1, 3 AS p2, 4 AS p3, 5 AS p4 FROM five
  UNION ALL SELECT {cols()} FROM ({step}))
SELECT 0::INT AS col_idx, q2 AS p2 FROM st ORDER BY n DESC LIMIT 1"""


def _spec_columns() -> str:
    """Types, classes and reasons of the stricter document for tables without risky names or texts of words."""
    both = {t: q.SCHEMAS[t] for t in ("lineitem", "orders")}
    cells = _union(f"SELECT '{t}.{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cols in both.items() for c in cols.split())
    mixed = "regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')"
    plain = f"regexp_matches(v, '^[0-9]+$') OR regexp_matches(v, {_t(spec.BOOLEANISH)}) OR regexp_matches(v, '^[A-Za-z]{{1,20}}$')"
    return f"""
WITH cells AS ({cells}),
freq AS (SELECT col, v, count(*) AS n FROM cells GROUP BY col, v),
facts AS (SELECT col, count(*) AS d, min(n) AS least, sum(n) AS rows, sum(CASE WHEN {plain} THEN n ELSE 0 END) AS plain, sum(CASE WHEN {mixed} THEN n ELSE 0 END) AS mixed, bool_or(({_anywhere()}) IS NOT NULL) AS personal FROM freq GROUP BY col),
typed AS {_typed(both)},
kinds AS (SELECT *, CASE WHEN dtype = 'string' AND d > {spec.CATEGORIES} THEN 'free_text' ELSE dtype END AS dt FROM facts JOIN typed USING (col)),
said AS (SELECT *, CASE WHEN dt IN ('date', 'datetime') THEN dt WHEN dt = 'free_text' THEN 'free_text_excluded' WHEN dt IN ('integer', 'numeric') AND d > {spec.CATEGORIES} THEN 'continuous' WHEN d > {spec.CATEGORIES} THEN 'high_cardinality' ELSE 'categorical' END AS kind FROM kinds),
why AS (SELECT *, CASE WHEN kind <> 'categorical' THEN kind || ' columns are not listed' WHEN rows < {spec.K} THEN 'n_rows < k' WHEN least < {spec.K} THEN 'small cells (count < k)'
  WHEN dt = 'string' AND personal THEN 'values match a pattern' WHEN dt = 'string' AND plain < 0.8 * rows THEN 'fewer than 80% of values match an allowed pattern' WHEN dt = 'string' AND mixed > 0.3 * rows THEN 'more than 30% of values mix letters and digits' END AS reason FROM said)
SELECT col, dt AS dtype, kind AS classification, (SELECT {BUCKET} FROM (SELECT least(d, 2000) AS n)) AS distinct, d > 2000 AS capped, '0' AS missing, reason IS NULL AS exported, reason, CASE WHEN reason IS NULL THEN d ELSE 0 END::INT AS listed, false AS risky, reason IS NOT NULL AS withheld FROM why"""


def _manifest_columns() -> str:
    cols = q.SCHEMAS["customer"].split()
    cells = _union(f"SELECT {i} AS i, '{c}' AS name, CAST({c} AS VARCHAR) AS v FROM customer" for i, c in enumerate(cols))
    names = _union(f"SELECT '{c}' AS name" for c in cols)
    bucket = lambda n: f"(SELECT {BUCKET} FROM (SELECT {n} AS n))"
    warning = f"CASE classification WHEN 'phi' THEN replace('{names_of.WARNINGS['phi'].replace(chr(39), chr(39) * 2)}', '{{}}', pattern) WHEN 'warning' THEN replace('{names_of.WARNINGS['warning'].replace(chr(39), chr(39) * 2)}', '{{}}', pattern) END"
    return f"""
WITH cells AS ({cells}),
agg AS (SELECT i, name, count(*) FILTER ({_missing('v')}) AS missing, count(*) FILTER (NOT {_missing('v')}) AS filled, count(DISTINCT v) AS d FROM cells GROUP BY i, name),
freq AS (SELECT name, v AS value, count(*) AS n FROM cells GROUP BY name, v),
lists AS (SELECT name, count(*) AS listed FROM freq WHERE {_listable()} GROUP BY name),
classes AS {_class('name', f'({names})')},
types AS (SELECT split_part(col, '.', 2) AS name, dtype FROM {_typed({'customer': q.SCHEMAS['customer']})})
SELECT i::INT AS col_idx, CASE WHEN classification = 'phi' THEN 'Column name matches PHI pattern' ELSE name END AS name, dtype, CASE WHEN d > 2000 AND classification <> 'phi' THEN 'high_cardinality' ELSE classification END AS classification,
  CASE WHEN dtype IN ('integer', 'numeric') THEN {bucket('filled')} ELSE '0' END AS n, {bucket('missing')} AS missing, CASE WHEN d > 2000 THEN 'High cardinality; exact count suppressed' ELSE {bucket('d')} END AS distinct,
  CASE WHEN classification = 'phi' OR d > 2000 THEN 0 ELSE coalesce(listed, 0) END::INT AS listed, {warning} AS warning
FROM agg JOIN classes USING (name) JOIN types USING (name) LEFT JOIN lists USING (name)"""


def _round_trips(sites: str) -> dict[str, str]:
    """The tables themselves, as they must come back from files."""
    parts = _values(rt.PATHS)
    number = f"CASE WHEN NOT {_numeric('t')} THEN NULL WHEN regexp_full_match(lower(t), '[+-]?(nan|inf|infinity)') THEN NULL ELSE TRY_CAST(t AS DOUBLE) END"
    kind = "CASE WHEN regexp_full_match(lower(t), '[+-]?nan') THEN 'nan' WHEN regexp_full_match(lower(t), '[+]?(inf|infinity)') THEN 'inf' WHEN regexp_full_match(lower(t), '-(inf|infinity)') THEN '-inf' ELSE 'number' END"
    ragged = "SELECT * FROM (VALUES ('key'), ('customer'), ('nation'), ('segment')) AS c(col)"
    return {
        "csv_rows": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS digest, lang IS NULL OR trim(lang) = '' AS no_lang, coalesce(source, '') AS source FROM documents",
        "tsv_rows": "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
        "csv_ragged": f"SELECT col, n AS rows, CASE WHEN col IN ('nation', 'segment') THEN n - short ELSE n END AS present, CASE col WHEN 'customer' THEN fifth ELSE 0 END AS missing, CASE WHEN col IN ('nation', 'segment') THEN n - short WHEN col = 'customer' THEN n - fifth ELSE n END AS filled FROM ({ragged}), (SELECT count(*) AS n, count(*) FILTER (c_custkey % 4 = 0) AS short, count(*) FILTER (c_custkey % 5 = 0) AS fifth FROM customer)",
        "workbook_rows": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS s_acctbal, CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END AS active, CAST(DATE '1899-12-30' + CAST(40000 + s_suppkey AS INT) AS VARCHAR) AS since, 40000.5 + s_suppkey::DOUBLE AS serial, s_suppkey % 11 = 0 OR s_suppkey % 3 = 0 AS no_note, CASE WHEN s_suppkey % 11 <> 0 AND s_suppkey % 3 <> 0 THEN ' ' || s_suppkey || ' & <co> ' END AS note FROM supplier",
        "workbook_profile": """
WITH a AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 7 = 0) AS seventh, count(*) FILTER (s_suppkey % 11 = 0 OR s_suppkey % 3 = 0) AS noted FROM supplier)
SELECT 'Rows' AS sheet, 0::INT AS col_idx, 'integer' AS dtype, 'safe' AS classification, n::VARCHAR AS n, '0' AS missing FROM a
UNION ALL SELECT 'Rows', 1, 'string', 'safe', '0', '0' FROM a
UNION ALL SELECT 'Rows', 2, 'numeric', 'safe', (n - seventh)::VARCHAR, seventh::VARCHAR FROM a
UNION ALL SELECT 'Rows', 3, 'boolean', 'safe', '0', '0' FROM a
UNION ALL SELECT 'Rows', 4, 'date', 'safe', n::VARCHAR, '0' FROM a
UNION ALL SELECT 'Rows', 5, 'string', 'safe', '0', noted::VARCHAR FROM a
UNION ALL SELECT 'Rows', NULL, NULL, NULL, n::VARCHAR, NULL FROM a
UNION ALL SELECT 'Empty', NULL, NULL, NULL, '0', NULL FROM a""",
        "formats": rf"SELECT v AS path, CASE WHEN regexp_matches(lower(v), '\.csv$') THEN 'csv' WHEN regexp_matches(lower(v), '\.(tsv|tab)$') THEN 'tsv' ELSE 'excel' END AS format FROM (VALUES {parts}) AS c(i, v)",
        "file_digest": "SELECT how, sha256('r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey)) AS digest FROM region, (VALUES ('here'), ('store')) AS h(how) GROUP BY how",
        "manifest_columns": _manifest_columns(),
        "recode_key": f"SELECT label, value, true AS listed FROM ({sites})",
        "spec_columns": _spec_columns(),
        "spec_medians": _union(f"SELECT '{c}' AS col, round(min({c})::DOUBLE, 6) AS low, round(max({c})::DOUBLE, 6) AS high, round(avg({c}), 6) AS mean, round(median({c})::DOUBLE, 6) AS median, 'exact' AS method FROM part" for c in ("p_partkey", "p_size", "p_retailprice")),
        "serial_days": "SELECT CAST(id AS INT) AS serial, CAST(DATE '1899-12-30' + CAST(id AS INT) AS VARCHAR) AS day FROM range(1, 60001, 7) AS t(id)",
        "numbers_of_text": f"SELECT v, {kind} AS kind, {number} AS x FROM (SELECT v, {_trim('v')} AS t FROM (SELECT v FROM (VALUES {_values(q.NUMBER_CASES)}) AS c(i, v) UNION ALL SELECT DISTINCT ' ' || CAST(p_retailprice AS DECIMAL(12, 2))::VARCHAR || chr(9) FROM part))",
        "normalized_names": f"SELECT v, strip_accents(lower(trim(v))) AS name FROM (SELECT DISTINCT v FROM (SELECT v FROM (VALUES {_values(rt.NAMES)}) AS c(i, v) UNION ALL SELECT unnest(string_split(string_split(text, chr(10))[1], ' ')) FROM documents WHERE text IS NOT NULL))",
    }


def oracle_sql() -> dict[str, str]:
    freq = lambda t, cols: _union(f"SELECT '{t}.{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} WHERE NOT {_missing(f'CAST({c} AS VARCHAR)')} GROUP BY 1, 2" for c in cols)
    numbers = (("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("lineitem", "l_tax"), ("part", "p_size"), ("part", "p_retailprice"), ("events", "value"))
    sites = "SELECT source AS value, 'Site_' || " + _label("(row_number() OVER (ORDER BY min(doc_id)) - 1)") + " AS label FROM documents WHERE source IS NOT NULL GROUP BY source"
    every = _union(f"SELECT '{t}' AS table_name, '{c}' AS column_name" for t, c in [*((t, c) for t, cols in q.SCHEMAS.items() for c in cols.split()), *(("(cases)", c) for c in q.NAME_HEADERS)])
    small = (("orders", "o_orderstatus"), ("part", "p_brand"), ("nation", "n_regionkey"), ("region", "r_name"))
    distinct = _union(f"SELECT '{t}.{c}' AS col, count(DISTINCT {c}) AS n FROM {t}" for t in ("lineitem", "orders", "part") for c in q.SCHEMAS[t].split())
    categories = _union(f"SELECT {i}::INT AS col_idx, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2 QUALIFY count(*) OVER () <= {spec.CATEGORIES}" for i, c in enumerate(("l_linenumber", "l_returnflag", "l_linestatus", "l_tax", "l_quantity")))
    return _round_trips(sites) | {
        "flagship": f"SELECT split_part(col, '.', 2) AS col, value, {BUCKET} AS bucket FROM ({freq('orders', ['o_orderstatus', 'o_orderpriority'])}) WHERE {_listable()}",
        "bucket_counts": f"SELECT value, n, {BUCKET} AS bucket FROM (SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1 UNION ALL SELECT CAST(n_regionkey AS VARCHAR), count(*) FROM nation GROUP BY 1)",
        "missing_counts": _union(f"SELECT '{t}.{c}' AS col, count(*) AS rows, count(*) FILTER ({_missing(f'CAST({c} AS VARCHAR)')}) AS missing FROM {t}" for t in ("events", "documents", "pages", "labels") for c in q.SCHEMAS[t].split()),
        "missing_tokens": f"SELECT i::INT AS i, v, {_missing('v')} AS missing FROM (VALUES {_values(q.MISSING_CASES)}) AS c(i, v)",
        "number_predicates": f"SELECT i::INT AS i, v, {_boolean(_trim('v'))} AS is_boolean, {_integer(_trim('v'))} AS is_integer, {_numeric(_trim('v'))} AS is_numeric FROM (VALUES {_values(q.NUMBER_CASES)}) AS c(i, v)",
        "date_predicates": f"SELECT v, {_date(_trim('v'))} AS is_date, {_datetime(_trim('v'))} AS is_datetime FROM (SELECT v FROM (VALUES {_values(q.DATE_CASES)}) AS c(i, v) UNION ALL SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') FROM orders)",
        "phi_patterns": f"SELECT i::INT AS i, v, {_kind('v')} AS kind FROM (VALUES {_values(q.PHI_CASES)}) AS c(i, v)",
        "phi_urls": f"SELECT col, coalesce({_kind('v')}, 'none') AS kind, count(*) AS n FROM (SELECT 'pages.url' AS col, url AS v FROM pages UNION ALL SELECT 'events.user_id', CAST(user_id AS VARCHAR) FROM events) GROUP BY 1, 2",
        "token_scan": f"SELECT doc_id, {_kind('v')} AS kind, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS v FROM documents) WHERE ({_kind('v')}) IS NOT NULL GROUP BY 1, 2",
        "name_detection": f"SELECT v, {_likely('v')} AS likely_name FROM (SELECT v FROM (VALUES {_values(q.NAME_CASES)}) AS c(i, v) UNION {' UNION '.join(f'SELECT {c} FROM {t} WHERE {c} IS NOT NULL' for t, c in q.NAME_COLUMNS)})",
        "p2_median": _p2("SELECT row_number() OVER (ORDER BY event_id) AS n, value AS x FROM events WHERE value IS NOT NULL"),
        "column_names": f"SELECT table_name, column_name, classification, pattern FROM ({every}) JOIN {_class('column_name', f'({every})')} USING (column_name)",
        "short_strings": "SELECT doc_id, CAST(strlen(text) AS INT) AS bytes, strlen(text) <= 32 AS short, strlen(text) > 100 OR contains(text, chr(10)) AS long FROM documents",
        "frequencies": _union(f"SELECT {i}::INT AS col_idx, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 2" for i, c in enumerate(("p_brand", "p_type", "p_size"))),
        "distinct_capped": f"SELECT col, CASE WHEN n <= 2000 THEN n END AS n_distinct, n > 2000 AS high, CASE WHEN n > 2000 THEN 'suppressed' ELSE {BUCKET} END AS said FROM ({distinct})",
        "k_anonymous_values": f"SELECT col, value, n FROM ({_union([freq('documents', ['source', 'lang']), freq('part', ['p_brand', 'p_type']), freq('lineitem', ['l_quantity', 'l_returnflag']), freq('conversations', ['role'])])}) WHERE {_listable()}",
        "numeric_profile": _union(f"SELECT '{t}.{c}' AS col, count({c}) AS n, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std_dev, round(var_samp({c}), 4) AS variance FROM {t}" for t, c in numbers),
        "median_exact": "SELECT median(l_quantity) AS quantity, round(median(l_extendedprice), 6) AS price FROM lineitem",
        "index_to_label": f"SELECT id, {_label('id')} AS label FROM range(0, 20000) AS t(id)",
        "recode_labels": sites,
        "recode_apply": f"SELECT label AS site, count(*) AS n FROM documents JOIN ({sites}) ON source = value GROUP BY label",
        "infer_dtype": f"SELECT * FROM {_typed(q.INFERRED)}",
        "table_profile": _profile(),
        "serial_dates": "SELECT CAST(id AS INT) AS serial, CAST(DATE '1899-12-30' + CAST(id AS INT) AS VARCHAR) AS day FROM range(1, 60001, 7) AS t(id)",
        "date_range": _union(f"SELECT '{t}.{a}' AS col, {f'strftime(min({c}), {iso})' if a == c else 'NULL'} AS first, {f'strftime(max({c}), {iso})' if a == c else 'NULL'} AS last, {'NULL::BOOLEAN' if a == c else f'count({c}) > 0'} AS present FROM {t}" for iso in ("'%Y-%m-%dT%H:%M:%S'",) for t, c, a in (("orders", "o_orderdate", "o_orderdate"), ("lineitem", "l_shipdate", "l_shipdate"), ("orders", "o_orderdate", "birth"))),
        "category_counts": f"SELECT col_idx, value, n, {BUCKET} AS bucket FROM ({categories})",
        "found_anywhere": f"SELECT i::INT AS i, v, {_anywhere()} AS kind FROM (VALUES {_values(q.PHI_CASES + q.DATE_CASES)}) AS c(i, v)",
        "small_cells": _union(f"SELECT '{t}.{c}' AS col, min(n) AS least, CAST(sum(n) AS BIGINT) AS rows, CASE WHEN sum(n) < 20 THEN 'n_rows < k' WHEN min(n) < 20 THEN 'small cells (count < k)' END AS reason FROM (SELECT count(*) AS n FROM {t} GROUP BY {c})" for t, c in small),
    }
