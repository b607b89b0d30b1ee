"""CSV and TSV with positional text columns, whatever the header says. Paths are Spark's: files, folders, patterns, any store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInputError

RAW = "__raw"


def _options(delimiter: str, multi_line: bool) -> dict:
    return {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": multi_line, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_header(spark: SparkSession, path: str, delimiter: str, multi_line: bool = True) -> list[str]:
    """The first record that isn't blank."""
    first = spark.read.csv(path, header=False, **_options(delimiter, multi_line))
    row = first.first() if first.columns else None
    return [x or "" for x in row] if row else []


def check_utf8(spark: SparkSession, path: str) -> None:
    """Raises if a file isn't UTF-8: what can't be decoded must not pass as other text. One scan of the bytes, split as lines are."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).select(F.input_file_name()).first()
    if bad:
        raise InvalidInputError(f"Not UTF-8: {bad[0]}")


def read_text(spark: SparkSession, path: str, delimiter: str = ",", multi_line: bool = True) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """Rows as text columns c0, c1 ...; the header; and for each column whether a row has that field at all.

    Rows may be short, which leaves their last fields absent rather than empty, or long, which is ignored. The files of
    a folder have one header. multi_line: fields may hold line breaks, at the price of one task a file; without it files are split.
    """
    header = read_header(spark, path, delimiter, multi_line)
    names = [f"c{i}" for i in range(len(header))]
    schema = ", ".join([*(f"{n} string" for n in names), f"{RAW} string"])
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, **_options(delimiter, multi_line))
    bare = F.regexp_replace(RAW, r'"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    return df, header, {n: F.col(RAW).isNull() | (fields > i) for i, n in enumerate(names)}
