"""The rules as SQL functions of a session (inlined by the optimizer, no Python)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import phi
from .functions import scalars as s


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _trimmed(v: str) -> str:
    return f"regexp_replace({v}, {_quoted(r'(?U)\A\s+|\s+\z')}, '')"


def definitions() -> dict[str, str]:
    """Name, and what follows CREATE TEMPORARY FUNCTION."""
    t = _trimmed("v")
    words = lambda xs: ", ".join(map(_quoted, xs))
    buckets = " ".join(f"WHEN n <= {top} THEN {_quoted(name)}" for top, name in s.BUCKETS)
    kinds = " ".join(f"WHEN rlike({t}, {_quoted(rf'(?U)\A(?:{p})\z')}) THEN {_quoted(k)}" for k, p in phi.PATTERNS)
    label, before = [], 0
    for n in range(1, 7):
        digits = ", ".join(f"char(pmod(floor((n - {before}) / {26**k}), 26) + 65)" for k in reversed(range(n)))
        label.append(f"WHEN n < {before + 26**n} THEN concat({digits})")
        before += 26**n
    return {
        "bucket_count": f"(n BIGINT) RETURNS STRING RETURN CASE {buckets} WHEN n IS NOT NULL THEN {_quoted(s.ABOVE)} END",
        "is_missing_token": f"(v STRING) RETURNS BOOLEAN RETURN coalesce(lower({t}) IN ({words(s.MISSING)}), true)",
        "phi_pattern": f"(v STRING) RETURNS STRING RETURN CASE {kinds} END",
        "index_to_label": f"(n BIGINT) RETURNS STRING RETURN CASE WHEN n < 0 THEN NULL {' '.join(label)} END",
        "is_boolean_text": f"(v STRING) RETURNS BOOLEAN RETURN lower({t}) IN ({words(s.TRUE + s.FALSE)})",
        "is_integer_text": f"(v STRING) RETURNS BOOLEAN RETURN rlike({t}, {_quoted(r'\A[+-]?[0-9]+\z')}) AND try_cast({t} AS BIGINT) IS NOT NULL",
        "is_numeric_text": f"(v STRING) RETURNS BOOLEAN RETURN rlike({t}, {_quoted(s.NUMBER)})",
        "is_datetime_text": f"(v STRING) RETURNS BOOLEAN RETURN rlike({t}, {_quoted(s.DATETIME)})",
    }


def register(spark: SparkSession) -> list[str]:
    for name, rest in (found := definitions()).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {rest}")
    return list(found)
