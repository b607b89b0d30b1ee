"""Queries over the sources and sinks: the driver's tables are written as files to the shared folder and read back."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phi
from ..functions import scalars as s
from ..operators.cells import cells_of
from ..options import Options
from ..scan import scan, scan_frame
from ..shared import shared_dir
from ..sources.book import serial_to_date
from ..sources.detect import format_of, sha256_of
from ..sources.sheets import open_book, read_sheet
from ..sources.text import RAW, read_text
from . import spec
from .manifest import write_json

PATHS = ("a.csv", "b.CSV", "c.tsv", "d.tab", "e.xlsx", "f.xls", "g.XLSM", "h.xlsb", "folder/visits.2024.csv", "s3://store/part/*.tsv")
NAMES = ("Smith", " JOHNSON ", "silva", "Wei", "Jean-Pierre", "Tremblay", "Côté", "João Silva", "MARIE CÔTÉ", "François Gagné", "José", "Treatment", "Control", "Øster", "Straße", "42", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


def _local(spark: SparkSession, name: str) -> Path:
    """A file that Python writes; the shared folder must be one of the machine's own paths for that."""
    path = Path(_place(spark, name).removeprefix("file://"))
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


def _csv(df: DataFrame, name: str, sep: str = ",") -> str:
    path = _place(df.sparkSession, name)
    df.write.csv(path, header=True, sep=sep, quoteAll=True, escape='"')
    return path


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with quotes, commas and line breaks through a folder of CSV files."""
    df, header, _ = read_text(spark, _csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "documents.csv"))
    assert header == ["doc_id", "text", "lang", "source"]
    return df.select(F.col("c0").cast("bigint").alias("doc_id"), F.octet_length(F.coalesce("c1", F.lit(""))).cast("bigint").alias("bytes"), F.sha2(F.coalesce("c1", F.lit("")), 256).alias("digest"), s.is_missing(F.col("c2")).alias("no_lang"), F.coalesce("c3", F.lit("")).alias("source"))


def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _, _ = read_text(spark, _csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "orders.tsv", "\t"), "\t", multi_line=False)
    return df.select(F.col("c0").cast("bigint").alias("o_orderkey"), F.col("c1").alias("o_orderstatus"), s.parse_numeric(s.trim(F.col("c2"))).alias("o_totalprice"), F.col("c3").alias("o_orderpriority"))


def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four customers one's line ends early, one's is too long; each fifth name is a missing token. What is absent isn't missing."""
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, "NA").otherwise(F.col("c_name"))
    line = F.when(key % 4 == 0, F.concat_ws(",", key, name)).when(key % 4 == 1, F.concat_ws(",", key, name, "c_nationkey", "c_mktsegment", F.lit("more"), F.lit("x"))).otherwise(F.concat_ws(",", key, name, "c_nationkey", "c_mktsegment"))
    lines = table(spark, sf_dir, "customer").select(key.alias("k"), line.alias("value"))
    head = spark.createDataFrame([(None, "key,customer,nation,segment")], lines.schema)
    path = _place(spark, "ragged.csv")
    head.unionByName(lines).coalesce(1).sortWithinPartitions(F.asc_nulls_first("k")).select("value").write.text(path)
    df, header, present = read_text(spark, path)
    cells = cells_of(df, header, present, columns=[c for c in df.columns if c != RAW])
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[f(x).alias(f"{n}_{c.index}") for c in cells for n, f, x in (("present", F.count_if, c.present), ("missing", F.count_if, c.present & c.missing), ("filled", F.count_if, c.filled))])
    each = [F.struct(F.lit(c.header).alias("col"), *[F.col(f"{n}_{c.index}").alias(n) for n in ("present", "missing", "filled")]) for c in cells]
    return wide.select("rows", F.explode(F.array(*each)).alias("x")).select("x.col", "rows", "x.present", "x.missing", "x.filled")


def _xlsx(path: Path, header: list[str], rows) -> None:
    """The smallest workbook of one filled and one empty sheet; a cell is a text, a number, a truth value, ("date", serial), ("error", text) or None."""
    letter = lambda k: chr(65 + k)

    def cell(k: int, n: int, x) -> str:
        at = f'r="{letter(k)}{n}"'
        if x is None:
            return ""
        if isinstance(x, tuple):
            return f'<c {at} s="1"><v>{x[1]}</v></c>' if x[0] == "date" else f'<c {at} t="e"><v>{x[1]}</v></c>'
        if isinstance(x, bool):
            return f'<c {at} t="b"><v>{int(x)}</v></c>'
        return f"<c {at}><v>{x!r}</v></c>" if isinstance(x, (int, float)) else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Rows" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s2.xml", "<worksheet><sheetData/></worksheet>")
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/s1.xml", "w") as out:
            out.write(b"<worksheet><sheetData>")
            for n, row in enumerate([header, *rows], 1):
                out.write(f'<row r="{n}">{"".join(cell(k, n, x) for k, x in enumerate(row))}</row>'.encode())
            out.write(b"</sheetData></worksheet>")


def _suppliers(spark: SparkSession, sf_dir: str) -> str:
    path = _local(spark, "suppliers.xlsx")
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").toLocalIterator()
    _xlsx(path, ["key", "company", "balance", "active", "since", "note"], ((k := r["s_suppkey"], r["s_name"], None if k % 7 == 0 else r["s_acctbal"], k % 2 == 0, ("date", 40000 + k + 0.5), ("error", "#N/A") if k % 11 == 0 else "n/a" if k % 3 == 0 else f" {k} & <co> ") for r in rows))
    return str(path)


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers through a workbook: texts, numbers, truth values, dates, errors and blanks."""
    df = read_sheet(spark, _suppliers(spark, sf_dir), 0)
    return df.select(F.col("c0").cast("bigint").alias("s_suppkey"), F.col("c1").alias("s_name"), F.col("n2").alias("s_acctbal"), F.col("c3").alias("active"), F.col("c4").alias("since"), F.col("n4").alias("serial"), s.is_missing(F.col("c5")).alias("no_note"), F.when(~s.is_missing(F.col("c5")), F.col("c5")).alias("note"))


def workbook_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of that workbook: every sheet in order; numbers count whatever the type, and an empty sheet has an exact 0."""
    got = scan(spark, _suppliers(spark, sf_dir), Options(bucket_counts=False, median="none"))
    said = lambda x: None if x is None else str(x["value"]["reason"] if x["type"] == "Suppressed" else x["value"])
    rows = [(one["name"], c["index"], c["dtype"], c["classification"], said(c["stats"]["count"]), said(c["stats"]["missing_count"])) for one in got.manifest["sheets"] for c in one["columns"]]
    rows += [(one["name"], None, None, None, said(one["row_count"]), None) for one in got.manifest["sheets"]]
    return spark.createDataFrame(rows, "sheet string, col_idx int, dtype string, classification string, n string, missing string")


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, format_of(p)) for p in PATHS], "path string, format string")


def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a file, read here and by Hadoop's client."""
    path = _local(spark, "region.csv")
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    path.write_text("".join(["r_regionkey,r_name\n", *(f"{r['r_regionkey']},{r['r_name']}\n" for r in rows)]), encoding="utf-8")
    return spark.createDataFrame([("here", sha256_of(path)), ("store", sha256_of(f"file:{path}", spark=spark))], "how string, digest string")


def _said(x: dict | None) -> str | None:
    return None if x is None else str(x["value"]["reason"]) if x["type"] == "Suppressed" else str(x["value"])


def manifest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of customer as its manifest says them, written to a file and read again."""
    path = _local(spark, "customer.json")
    write_json(scan_frame(table(spark, sf_dir, "customer"), "customer", Options(median="none")).manifest, path)
    doc = json.loads(path.read_text(encoding="utf-8"))
    rows = [(c["index"], _said(c["name"]) if isinstance(c["name"], dict) else c["name"], c["dtype"], c["classification"], _said(c["stats"]["count"]), _said(c["stats"]["missing_count"]), _said(c["stats"]["unique_count"]), len(c.get("unique_values", [])), (c.get("warnings") or [None])[0]) for c in doc["sheets"][0]["columns"]]
    return spark.createDataFrame(rows, "col_idx int, name string, dtype string, classification string, n string, missing string, distinct string, listed int, warning string")


def recode_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of the labels that a CSV of documents' sources, under the name of a site, leaves behind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site_code"))
    path = _place(spark, "sites.csv")
    docs.coalesce(1).sortWithinPartitions("doc_id").write.csv(path, header=True)
    got = scan(spark, path, Options(hash_file=False, median="none"))
    lines = [x.split(" = ", 1) for x in (got.recode_key or "").splitlines() if " = " in x]
    shown = {v["value"] for v in got.manifest["sheets"][0]["columns"][1]["unique_values"]}
    return spark.createDataFrame([(label, value, label in shown) for label, value in lines], "label string, value string, listed boolean")


def spec_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stricter document says of lineitem's and orders' columns."""
    rows = []
    for name in ("lineitem", "orders"):
        sheet, risky, withheld = spec.spec_sheet(table(spark, sf_dir, name), name, 0, spec.spec_options())
        for c in sheet["columns"]:
            rows.append((f"{name}.{c['name']}", c["dtype"], c["classification"], c["unique_count"], c["unique_count_capped"], c["missing_count"], c["exported_values"], c.get("suppression_reason"), len(c.get("values", [])), c["name"] in risky, c["name"] in withheld))
    return spark.createDataFrame(rows, "col string, dtype string, classification string, distinct string, capped boolean, missing string, exported boolean, reason string, listed int, risky boolean, withheld boolean")


def spec_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the relaxed document, whose medians are exact, and what it calls the method."""
    sheet, *_ = spec.spec_sheet(table(spark, sf_dir, "part"), "part", 0, spec.spec_options(relaxed=True))
    rows = [(c["name"], *(round(float(c["stats"][k]), 6) for k in ("min", "max", "mean", "median")), c["stats"]["median_method"]) for c in sheet["columns"] if "stats" in c]
    return spark.createDataFrame(rows, "col string, low double, high double, mean double, median double, method string")


def serial_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workbook readers' own conversion."""

    @F.pandas_udf("string")
    def day(serials: pd.Series) -> pd.Series:
        return serials.map(serial_to_date)

    return spark.range(1, 60001, 7).select(F.col("id").cast("int").alias("serial"), day(F.col("id") + 0.75).alias("day"))


def numbers_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as text, padded, of parts and of cases."""
    from .queries import NUMBER_CASES

    parts = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("\t")).alias("v")).distinct()
    both = spark.createDataFrame([(v,) for v in NUMBER_CASES], "v string").unionByName(parts)
    x = s.parse_numeric(s.trim(F.col("v")))
    return both.select("v", F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise("number").alias("kind"), F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias("x"))


def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, and the words of the first lines of all documents, without case and accents."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(phi.normalize_name)

    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.substring_index("text", "\n", 1), " ")).alias("v")).distinct()
    both = spark.createDataFrame([(v,) for v in NAMES], "v string").unionByName(words).distinct()
    return both.select("v", plain("v").alias("name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (csv_rows, tsv_rows, csv_ragged, workbook_rows, workbook_profile, formats, file_digest, manifest_columns, recode_key, spec_columns, spec_medians, serial_days, numbers_of_text, normalized_names)
    return {f.__name__: f for f in found}
