"""Columns of a table as text cells, with what is known from their types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as s


Rule = Column | bool


@dataclass(frozen=True)
class Cell:
    """One column's expressions. What the column's type already decides is True or False, and costs no pattern."""

    index: int
    header: str
    raw: Column
    text: Column
    present: Column
    missing: Column
    boolean: Rule
    integer: Rule
    numeric: Rule
    date: Rule
    datetime: Rule
    long: Rule
    number: Column | None

    @property
    def filled(self) -> Column:
        return self.present & ~self.missing


def free_name(taken: list[str], name: str) -> str:
    """A column name that no given column has, whatever its case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def cell(df: DataFrame, name: str, index: int, header: str | None = None, present: Column | None = None, number: Column | None = None) -> Cell:
    """number: where numbers come from, if not from the text (workbooks)."""
    col, kind = F.col(f"`{name}`"), df.schema[name].dataType
    there = present if present is not None else F.lit(True)
    own = {"index": index, "header": header if header is not None else name, "present": there}
    plain = {"raw": col, "text": col.cast("string"), "missing": col.isNull(), "boolean": False, "integer": False, "numeric": False, "date": False, "datetime": False, "long": False, "number": None}
    if isinstance(kind, T.IntegralType):
        return Cell(**own | plain | {"boolean": col.isin(0, 1), "integer": True, "numeric": True, "number": col.cast("double")})
    if isinstance(kind, T.FractionalType):
        return Cell(**own | plain | {"missing": col.isNull() | F.isnan(col.cast("double")), "numeric": True, "number": col.cast("double")})
    if isinstance(kind, T.BooleanType):
        return Cell(**own | plain | {"boolean": True})
    if isinstance(kind, T.DateType):
        return Cell(**own | plain | {"date": True})
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Cell(**own | plain | {"datetime": True})
    text = col if isinstance(kind, T.StringType) else F.to_json(col) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else col.cast("string")
    t = s.trim(text)
    return Cell(**own, raw=text, text=text, missing=s.is_missing(text), boolean=s.is_boolean(t), integer=s.is_integer(t), numeric=s.is_numeric(t), date=s.is_date(t), datetime=s.is_datetime(t), long=s.is_long(text), number=number if number is not None else s.parse_numeric(t))


def cells_of(df: DataFrame, headers: list[str] | None = None, present: dict[str, Column] | None = None, numbers: dict[str, str] | None = None, columns: list[str] | None = None) -> list[Cell]:
    names = columns if columns is not None else df.columns
    return [cell(df, n, i, headers[i] if headers else None, (present or {}).get(n), F.col(f"`{numbers[n]}`") if numbers else None) for i, n in enumerate(names)]


def long_form(df: DataFrame, cells: list[Cell], row: Column | None = None) -> DataFrame:
    """col_idx, value (raw text) of cells that aren't missing, and row_idx if asked for."""
    keep = [row.alias("row_idx")] if row is not None else []
    each = F.array(*[F.struct(F.lit(c.index).alias("col_idx"), F.when(c.filled, c.text).alias("value")) for c in cells])
    return df.select(*keep, F.explode(each).alias("c")).where("c.value is not null").select(*(["row_idx"] if keep else []), "c.col_idx", "c.value")
