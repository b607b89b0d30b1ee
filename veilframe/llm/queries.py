"""The registered queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hosts, iblt, langid, licenses, mixing, secrets, sharding, simhash, warc
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_with_next(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("host_rate")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontaminate, op2_fingerprint, op3_warc, op4_simhash, op5_licenses, op6_secrets, op7_url_filter, op8_mix, op9_language, op10_shard)
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP1 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (
  SELECT p.doc_id, p.i, p.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM places) p JOIN windows win ON p.win = win.win AND p.n = win.n),
hit_words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""

OP3 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

def op5_sql() -> str:
    """Phrases and containments straight from the word lists: each template against each block."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = f"translate(coalesce(text, ''), '{hosts.UPPER}', '{hosts.LOWER}')"
    phrases = ", ".join(f"({_text(p)}, {len(p.split())}, {_text(v)})" for p, v in licenses.PHRASES.items())
    templates = ", ".join(f"({sorted(set(t.split()))}, {_text(v)})" for t, v in sorted(licenses.TEMPLATES.items()))
    return f"""
WITH phrases(p, n, label) AS (VALUES {phrases}),
templates(own, label) AS (VALUES {templates}),
d AS (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (SELECT doc_id, i - 1 AS pos, label FROM places, phrases WHERE w[i] = split_part(p, ' ', 1) AND array_to_string(list_slice(w, i, i + n - 1), ' ') = p),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS base_list FROM hits GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(array_to_string(list_slice(lines, k, k + {licenses.LINES - 1}), chr(10))), '{word}')) AS b FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, list_filter(lines, lambda x: regexp_matches(x, '{word}')) AS lines FROM d))),
matched AS (SELECT doc_id, label, len(list_intersect(own, b)) AS n, len(own) AS size FROM blocks, templates WHERE len(list_intersect(own, b)) >= CASE WHEN len(own) < {licenses.WHOLE} THEN len(own) ELSE ceil({licenses.SHARE} * len(own) - 1e-9) END),
best AS (SELECT doc_id, list(DISTINCT label) AS more, max(n / size) AS best FROM matched GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def op6_sql() -> str:
    """Spans from the pieces between matches; the entropy of each window counted anew."""
    ctes, kinds = [], [*secrets.KINDS, ("entropy", secrets.CANDIDATE % secrets.WINDOW, 0, secrets.WINDOW)]
    for k, (_, pattern, group, least) in enumerate(kinds):
        rx = _text(pattern.removeprefix("(?i)"))
        flags = ", 'i'" if pattern.startswith("(?i)") else ""
        ctes.append(f"""
m{k} AS (SELECT doc_id, t, string_split_regex(t, {rx}{flags}) AS p, regexp_extract_all(t, {rx}, 0{flags}) AS m, regexp_extract_all(t, {rx}, {group}{flags}) AS g FROM d),
s{k} AS (SELECT doc_id, t, {k} AS kind, list_sum(list_transform(p[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)::BIGINT AS start, m[i] AS s, g[i] AS g FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{k})),
f{k} AS (SELECT doc_id, t, kind, start, start + length(s) AS stop, s FROM s{k} WHERE length(g) >= {least})""")
    last, w = len(kinds) - 1, secrets.WINDOW
    terms = [secrets._term(n) for n in range(w + 1)]
    hex_bits, other_bits = (secrets.most_repetition(c[2], w) for c in secrets.CLASSES)
    names = [k for k, *_ in kinds]
    base = " UNION ALL ".join(f"SELECT doc_id, kind, start, stop FROM f{k}" for k in range(last))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{",".join(ctes)},
base AS ({base}),
points AS (SELECT doc_id, start AS low, stop AS high, s, start AS p FROM f{last} UNION SELECT c.doc_id, c.start, c.stop, c.s, b.stop FROM f{last} c JOIN base b ON b.doc_id = c.doc_id AND b.start < c.stop AND c.start < b.stop AND b.stop < c.stop),
pieces AS (SELECT a.doc_id, a.low, a.s, a.p, least(a.high, coalesce(min(b.start), a.high)) AS stop FROM (SELECT * FROM points a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.start <= a.p AND a.p < b.stop)) a LEFT JOIN base b ON b.doc_id = a.doc_id AND b.start >= a.p GROUP BY a.doc_id, a.low, a.high, a.s, a.p),
apart AS (SELECT DISTINCT doc_id, p AS start, stop, substr(s, (p - low + 1)::BIGINT, (stop - p)::BIGINT) AS s FROM pieces WHERE stop - p >= {w}),
unlike AS (SELECT * FROM apart WHERE NOT (regexp_full_match(s, '([A-Za-z]?[a-z]*|[A-Z]+|[0-9]+)([-_/+=]([A-Za-z]?[a-z]*|[A-Z]+|[0-9]+))*') OR regexp_full_match(s, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') OR replace(s, left(s, 1), '') = '')),
win AS (SELECT doc_id, start, stop, s, i, substr(s, i, {w}) AS v FROM (SELECT *, unnest(range(1, length(s) - {w - 2})) AS i FROM unlike)),
sums AS (SELECT doc_id, start, stop, s, i, sum({terms}[n + 1]) AS total FROM (SELECT doc_id, start, stop, s, i, c, count(*) AS n FROM (SELECT *, unnest(string_split(v, '')) AS c FROM win) GROUP BY ALL) GROUP BY ALL),
more AS (SELECT doc_id, {last} AS kind, start, stop FROM sums GROUP BY doc_id, start, stop, s HAVING min(total) <= CASE WHEN regexp_full_match(s, '[0-9A-Fa-f]+') THEN {hex_bits} ELSE {other_bits} END),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
said AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {last}) AS b, string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN said USING (doc_id)
"""


def op7_sql() -> str:
    rule, verdict = "NULL", "NULL"
    for what, text in sorted(hosts.RULES, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    second = ", ".join(f"'{s}'" for s in hosts.SECOND)
    few = r"(len(l) < 2 OR starts_with(name, '[') OR regexp_full_match(name, '[0-9]{1,3}(\.[0-9]{1,3}){3}'))"
    two = f"(length(l[-1]) = 2 AND l[-2] IN ({second}))"
    name = r"regexp_replace(CASE WHEN starts_with(host, '[') THEN regexp_extract(host, '^\[[^\]]*\]?') ELSE regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') END, '\.+$', '')"
    shrink = lambda child, parent, rate: f"(SELECT c.*, {rate} AS prior FROM {child} c {parent})"
    strength = "(SELECT 1 / least(greatest(CASE WHEN sum((n - 1) * prior * (1 - prior)) = 0 THEN 0 ELSE (sum(n * power(bad / n - prior, 2)) - sum(prior * (1 - prior))) / sum((n - 1) * prior * (1 - prior)) END, 0.001), 0.999) - 1 FROM {t} WHERE n > 0)"
    level = lambda name, source: f"{name}_p AS ({source}), {name} AS (SELECT *, n + {strength.format(t=name + '_p')} AS weight, (bad + {strength.format(t=name + '_p')} * prior) / (n + {strength.format(t=name + '_p')}) AS rate FROM {name}_p)"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{hosts.UPPER}', '{hosts.LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
marks AS (SELECT doc_id, CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END AS bad FROM labels),
counts AS (SELECT host, count(bad) AS n, sum(coalesce(bad, 0)) AS bad, {name} AS name FROM seen LEFT JOIN marks ON page_id = doc_id GROUP BY host),
tails AS (SELECT *, string_split(name, '.') AS l, array_to_string(l[-2:], '.') AS last2 FROM counts),
h AS (SELECT host, n, bad, CASE WHEN {few} THEN name WHEN {two} AND len(l) > 2 THEN array_to_string(l[-3:], '.') ELSE last2 END AS domain,
  CASE WHEN {few} THEN '' WHEN {two} THEN last2 ELSE l[-1] END AS suffix FROM tails),
overall AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS r FROM h),
suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix),
dom AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
{level("s", shrink("suf", ", overall", "r"))},
{level("m", shrink("dom", "JOIN s USING (suffix)", "s.rate"))},
{level("o", shrink("h", "JOIN m USING (domain, suffix)", "m.rate"))}
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN o.rate - {hosts.Z} * sqrt(o.rate * (1 - o.rate) / (o.weight + 1)) > {hosts.MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict
FROM seen JOIN o USING (host)
"""


def op8_sql() -> str:
    seed = mixing.SEED
    unit = lambda text: f"('0x' || substr(md5({text}), 1, 13))::BIGINT"
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n, power(count(*), {mixing.ALPHA}) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
steps(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 12)),
cdf AS (SELECT source, list(c ORDER BY k) AS at_most FROM steps GROUP BY source),
drawn AS (SELECT d.*, len(list_filter(at_most, lambda c: c <= {unit(f"'{seed}:1:' || doc_id")} / 4503599627370496.0)) AS times FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1))::INT AS copy FROM drawn)
SELECT *, {unit(f"'{seed}:order:' || copy || ':' || doc_id")} AS mix_key FROM copies
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op3_warc": OP3, "op5_licenses": op5_sql(), "op6_secrets": op6_sql(), "op7_url_filter": op7_sql(), "op8_mix": op8_sql()}
