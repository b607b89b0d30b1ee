"""From a file to its manifest."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions.phi import NameLists
from .operators.recode import sidekick
from .options import Options
from .plans import manifest as mf
from .plans.profile import WIDE_TEXT, TableProfile, profile
from .sources.detect import format_of, sha256_of


@dataclass
class Scan:
    manifest: dict
    recode_key: str | None = None
    tables: tuple[TableProfile, ...] = ()


def scan(spark: SparkSession, path: str, options: Options = Options(), names: NameLists | None = None, multi_line: bool = True) -> Scan:
    """Profiles a CSV, TSV or workbook. recode_key tells which site stands behind each label, and is there only if one does."""
    kind = format_of(path)
    digest = sha256_of(path, spark=spark) if options.hash_file else None
    key, tables, sheets, file_name = None, [], [], Path(path).name
    if kind == "excel":
        from .sources.sheets import open_book, read_sheet

        book = open_book(path)
        for i, (name, _) in enumerate(book.sheets):
            header, _ = book.shape(i)
            table = TableProfile(0, [])
            if header:
                n = len(header)
                df = read_sheet(spark, path, i)
                table = profile(df, options, names, header, numbers={f"c{k}": f"n{k}" for k in range(n)}, columns=[f"c{k}" for k in range(n)], workbook=True, wide=WIDE_TEXT)
            tables.append(table)
            sheets.append(mf.sheet(name, i, table, options))
    else:
        from .sources.text import RAW, check_utf8, read_text

        check_utf8(spark, path)
        df, header, present = read_text(spark, path, "\t" if kind == "tsv" else ",", multi_line)
        table = profile(df, options, names, header, present=present, columns=[c for c in df.columns if c != RAW], wide=WIDE_TEXT) if header else TableProfile(0, [])
        tables.append(table)
        one = mf.sheet(file_name, 0, table, options)
        if not header:
            from .plans.profile import safe_count

            one["row_count"] = safe_count(0, options.bucketed)
        sheets.append(one)
        if any(table.labels.values()):
            now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")
            key = sidekick({c.index: c.header for c in table.columns}, table.labels, now)
    return Scan(mf.manifest(file_name, kind, sheets, options, digest), key, tuple(tables))


def scan_frame(df: DataFrame, name: str = "table", options: Options = Options(median="approx"), names: NameLists | None = None, order_by: str | None = None) -> Scan:
    """Profiles any DataFrame: Parquet, tables, queries. Its median is a mergeable sketch unless options say otherwise."""
    table = profile(df, options, names, order_by=order_by)
    return Scan(mf.manifest(name, "dataframe", [mf.sheet(name, 0, table, options)], options), None, (table,))
