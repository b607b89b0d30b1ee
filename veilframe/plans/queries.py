"""Each operator of the engine as a query over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as names_of
from ..functions import phi
from ..functions import scalars as s
from ..operators import frequencies as fr
from ..operators import recode
from ..operators.cells import cells_of, long_form
from ..operators.infer import infer_types
from ..operators.jobs import at_once
from ..operators.p2 import p2_by_column
from ..options import Options
from . import round_trips, spec
from .profile import measured, profile

SCHEMAS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
ROUND = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be shared of orders' categories: values that occur k times and look like nothing personal (names too), with bucketed counts."""
    df = table(spark, sf_dir, "orders")
    cells = cells_of(df, columns=["o_orderstatus", "o_orderpriority"])
    listed = unnamed(fr.exportable(fr.frequencies(df, cells), 5))
    name = F.element_at(F.create_map(*[F.lit(x) for c in cells for x in (c.index, c.header)]), F.col("col_idx"))
    return listed.select(name.alias("col"), "value", s.bucket_count(F.col("n")).alias("bucket"))


def unnamed(listed: DataFrame) -> DataFrame:
    """Without values that are likely names; there are at most a few thousand to a column."""
    return listed.where(~phi.likely_name(phi.NameLists.of())(F.col("value")))


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b).unionByName(c).select("value", "n", s.bucket_count(F.col("n")).alias("bucket"))


def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per column: rows, missing and filled cells. Text columns are tested for tokens, others for nulls and NaN."""
    out = None
    for name in ("events", "documents", "pages", "labels"):
        df = table(spark, sf_dir, name)
        cells = cells_of(df)
        wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c.missing, 1)).alias(c.header) for c in cells])
        one = wide.select("rows", F.explode(F.array(*[F.struct(F.lit(f"{name}.{c.header}").alias("col"), F.col(c.header).alias("missing")) for c in cells])).alias("x")).select("x.col", "rows", "x.missing")
        out = one if out is None else out.unionByName(one)
    return out


MISSING_CASES = ("NA", " n/a ", "null", "NaN", ".", "-", "--", "Missing", "none", "#N/A", "#DIV/0!", "#NAME?", "0", "test", "NAN ", "n.a.", "---", "no", " ", "")
NUMBER_CASES = ("42", "-42", "+7", "3.14", ".5", "1.", "1e10", "-1E-5", "1d", "1.5f", "abc", "", "inf", "-Infinity", "+nan", "0x10", "1_000", "1,000", "9223372036854775807", "9223372036854775808", "e5", ".", "+", "true", "Y", "f", "maybe", "2")
DATE_CASES = ("2024-01-15", "2024-02-30", "01/15/2024", "13/01/2024", "15-01-2024", "31-04-2024", "1/5/24", "January 5, 2024", "Jan 5, 2024", "Febtober 5, 2024", "January 5 2024", "2024.01.15", "2024.13.15", "2024-01-15T10:30:00", "2024-01-15 10:30:00", "2024-01-15T10:30:00Z", "2024-01-15T10:30:00.125", "2024-99-99T99:99:99", "2024-01-15T10:30:00+02:00", "text", "")
PHI_CASES = ("a.b@example.com", "a@b", "(604) 555-1234", "604.555.1234", "6045551234", "123-45-6789", "123456789", "12345", "12345-6789", "1234", "V6T 1Z4", "v6t1z4", "AB12345678", "ABCDEFGHIJ", "1234567890123", "https://x.org/a", "http://", "10.0.0.1", "999.1.1.1", "::1", "fe80::", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "00:1A:2B:3C:4D:5E", "00-1a-2b-3c-4d-5e", "42", "Male", "Treatment A", "2024-01-15", "3.14159", " 12345 ")
NAME_CASES = ("Smith", "JOHNSON", "silva", "Wei", "Jean-Pierre", "Joao Silva", "João Silva", "Côté", "CÔTÉ", "François Gagné", "Mary Q Smith", "Kim Novak", "Ana M. Prado", "Zoé Ötzi-Berg", "Treatment", "Control", "Treatment A", "Not applicable", "42", "ABCD1234", "X", "Garcia Unknown", "Unknown Person", "GARCIA unknown", "PROMO BRUSHED TIN")


def _cases(spark: SparkSession, values) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, MISSING_CASES).select("i", "v", s.is_missing(F.col("v")).alias("missing"))


def number_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = s.trim(F.col("v"))
    return _cases(spark, NUMBER_CASES).select("i", "v", s.is_boolean(t).alias("is_boolean"), s.is_integer(t).alias("is_integer"), s.is_numeric(t).alias("is_numeric"))


def date_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases, and the order dates as text."""
    texts = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("v")).distinct()
    both = _cases(spark, DATE_CASES).select("v").unionByName(texts)
    t = s.trim(F.col("v"))
    return both.select("v", s.is_date(t).alias("is_date"), s.is_datetime(t).alias("is_datetime"))


def phi_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, PHI_CASES).select("i", "v", phi.pattern_kind(F.col("v")).alias("kind"))


def phi_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds found in the values of pages.url and events.user_id."""
    both = table(spark, sf_dir, "pages").select(F.lit("pages.url").alias("col"), F.col("url").alias("v")).unionByName(table(spark, sf_dir, "events").select(F.lit("events.user_id").alias("col"), F.col("user_id").cast("string").alias("v")))
    return both.withColumn("kind", F.coalesce(phi.pattern_kind(F.col("v")), F.lit("none"))).groupBy("col", "kind").agg(F.count(F.lit(1)).alias("n"))


def token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the whole-value rules applied to each word of each document."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[ \n]+")).alias("w"))
    kind = phi.pattern_kind(F.col("w"))
    # letters and marks alone are most words, and have no pattern
    return words.where(F.col("w").rlike(r"[0-9@:]")).select("doc_id", kind.alias("kind")).where("kind is not null").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def name_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases, and the distinct values of text columns of five tables."""
    both = _cases(spark, NAME_CASES).select("v")
    for name, col in NAME_COLUMNS:
        both = both.unionByName(table(spark, sf_dir, name).select(F.col(col).alias("v")))
    both = both.where("v is not null").distinct()
    return both.select("v", phi.likely_name(phi.NameLists.of())(F.col("v")).alias("likely_name"))


NAME_COLUMNS = (("region", "r_name"), ("nation", "n_name"), ("part", "p_name"), ("part", "p_type"), ("customer", "c_mktsegment"), ("customer", "c_name"), ("conversations", "role"))


def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, c, (k := names_of.check_name(c)).classification, k.pattern) for t, cols in SCHEMAS.items() for c in cols.split()]
    rows += [("(cases)", c, (k := names_of.check_name(c)).classification, k.pattern) for c in NAME_HEADERS]
    return spark.createDataFrame(rows, "table_name string, column_name string, classification string, pattern string")


NAME_HEADERS = ("patient_name", "first_name", "mac_address", "Date-of-Birth", "pt_age", "visit_pt", "site_code", "Hospital", "clinic id", "centre", "dose_mg", "id", "case.number", "filename", "treatment", "uf", "e-mail", "zip code", "adm_case", "nome_mae")


def short_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).alias("bytes"), s.short_enough(text).alias("short"), s.is_long(text).alias("long"))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return fr.frequencies(df, cells_of(df, columns=["p_brand", "p_type", "p_size"])).select("col_idx", "value", "n")


def distinct_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of all columns of lineitem, orders and part; null beyond the cap."""

    def one(name: str) -> list[tuple]:
        df = table(spark, sf_dir, name)
        cells = cells_of(df)
        high = fr.proven_high(df, cells, 2000)
        todo = [c for c in cells if c.index not in high]
        found = {r["col_idx"]: r["n_distinct"] for r in fr.distinct_counts(fr.frequencies(df, todo)).collect()} if todo else {}
        return [(f"{name}.{c.header}", n if (n := found.get(c.index, 0)) <= 2000 and c.index not in high else None, c.index in high or n > 2000) for c in cells]

    out = [x for xs in at_once(spark, [lambda name=name: one(name) for name in ("lineitem", "orders", "part")]) for x in xs]
    return spark.createDataFrame([(c, n, h, "suppressed" if h else s.bucket_name(n)) for c, n, h in out], "col string, n_distinct bigint, high boolean, said string")


def k_anonymous_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, cols in (("documents", ["source", "lang"]), ("part", ["p_brand", "p_type"]), ("lineitem", ["l_quantity", "l_returnflag"]), ("conversations", ["role"])):
        df = table(spark, sf_dir, name)
        cells = cells_of(df, columns=cols)
        header = F.element_at(F.create_map(*[F.lit(x) for c in cells for x in (c.index, f"{name}.{c.header}")]), F.col("col_idx"))
        one = unnamed(fr.exportable(fr.frequencies(df, cells), 5)).select(header.alias("col"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, cols in (("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), ("part", ["p_size", "p_retailprice"]), ("events", ["value"])):
        df = table(spark, sf_dir, name)
        for c in cells_of(df, columns=cols):
            x = F.when(c.filled, c.number)
            one = df.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg(x), ROUND).alias("mean"), F.round(F.stddev_samp(x), ROUND).alias("std_dev"), F.round(F.var_samp(x), 4).alias("variance")).select(F.lit(f"{name}.{c.header}").alias("col"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def median_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.percentile("l_quantity", 0.5).alias("quantity"), F.round(F.percentile("l_extendedprice", 0.5), ROUND).alias("price"))


def p2_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.lit(0).alias("col_idx"), F.col("event_id").alias("row_idx"), F.col("value").alias("num"))
    return p2_by_column(df)


def index_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 20000).select("id", s.index_to_label(F.col("id")).alias("label"))


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site"))
    freq = fr.frequencies(docs, cells_of(docs, columns=["site"]), None)
    first = docs.where(F.col("site").isNotNull()).groupBy("site").agg(F.min("doc_id").alias("first_row"))
    freq = freq.join(first, freq["value"] == first["site"]).select("col_idx", "value", "first_row")
    return docs, recode.dictionary(freq, {0: names_of.recode_prefix("site")})


def recode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir)[1].select("value", "label")


def recode_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _sites(spark, sf_dir)
    return recode.apply(docs, "site", labels.select("value", "label")).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


INFERRED = {t: SCHEMAS[t] for t in ("region", "customer", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")}


def infer_dtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of all columns of nine tables; row order by the scan."""

    def one(name: str) -> list[tuple[str, str]]:
        df = table(spark, sf_dir, name).withColumn("__row", F.monotonically_increasing_id())
        cells = cells_of(df, columns=INFERRED[name].split())
        marked, got = measured(df, cells, "__row", numbers=False)
        types = infer_types(marked, cells, F.col("__row"), got)
        return [(f"{name}.{c.header}", types[c.index]) for c in cells]

    out = at_once(spark, [lambda name=name: one(name) for name in INFERRED])
    return spark.createDataFrame([x for xs in out for x in xs], "col string, dtype string")


def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile of lineitem and orders: types, classes, counts and statistics, exact medians among them."""
    r = lambda x: None if x is None else round(float(x), ROUND)

    def one(name: str) -> list[tuple]:
        columns = profile(table(spark, sf_dir, name), Options(median="exact")).columns
        return [(f"{name}.{c.header}", c.dtype, c.classification, c.non_missing, c.missing, c.n_distinct, len(c.values), r(c.min), r(c.max), r(c.mean), r(c.std_dev), r(c.median)) for c in columns]

    out = at_once(spark, [lambda name=name: one(name) for name in ("lineitem", "orders")])
    return spark.createDataFrame([x for xs in out for x in xs], "col string, dtype string, classification string, non_missing bigint, missing bigint, n_distinct bigint, listed bigint, low double, high double, mean double, std_dev double, median double")


def serial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook serials to dates: the epoch plus whole days."""
    return spark.range(1, 60001, 7).select(F.col("id").cast("int").alias("serial"), F.date_add(F.lit("1899-12-30").cast("date"), F.col("id").cast("int")).cast("string").alias("day"))


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of date columns in the stricter document; one whose name is risky shows none."""
    out = []
    for name, col, alias in (("orders", "o_orderdate", "o_orderdate"), ("lineitem", "l_shipdate", "l_shipdate"), ("orders", "o_orderdate", "birth")):
        sheet, *_ = spec.spec_sheet(table(spark, sf_dir, name).select(F.col(col).alias(alias)), name, 0, spec.spec_options())
        said = sheet["columns"][0]["range"]
        out.append((f"{name}.{alias}", said.get("min"), said.get("max"), said.get("range_present")))
    return spark.createDataFrame(out, "col string, first string, last string, present boolean")


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of at most ten values, with counts."""
    df = table(spark, sf_dir, "lineitem")
    cells = cells_of(df, columns=["l_linenumber", "l_returnflag", "l_linestatus", "l_tax", "l_quantity"])
    freq = long_form(df, cells).groupBy("col_idx", "value").agg(F.count(F.lit(1)).alias("n"))
    return spec.category_counts(freq).select("col_idx", F.explode("values").alias("x")).select("col_idx", "x.value", "x.n", s.bucket_count(F.col("x.n")).alias("bucket"))


def found_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, PHI_CASES + DATE_CASES).select("i", "v", spec.found_anywhere(F.col("v")).alias("kind"))


def small_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every value of a column occurs k times, and whether the table has k rows at all."""
    out = []
    for name, col in (("orders", "o_orderstatus"), ("part", "p_brand"), ("nation", "n_regionkey"), ("region", "r_name")):
        least, rows = table(spark, sf_dir, name).groupBy(col).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.sum("n")).first()
        out.append((f"{name}.{col}", least, rows, spec.small_cells((least,), rows, spec.K)))
    return spark.createDataFrame(out, "col string, least bigint, rows bigint, reason string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (flagship, bucket_counts, missing_counts, missing_tokens, number_predicates, date_predicates, phi_patterns, phi_urls, token_scan, name_detection, column_names, short_strings, frequencies, distinct_capped, k_anonymous_values, numeric_profile, median_exact, p2_median, index_to_label, recode_labels, recode_apply, infer_dtype, table_profile, serial_dates, date_range, category_counts, found_anywhere, small_cells)
    return {f.__name__: f for f in found} | round_trips.queries()
