"""Workbooks as a Python data source: one partition a sheet.

Format name: veil_workbook. Options: path, sheet (index from 0). Columns: c0, c1 ... (text) and
n0, n1 ... (the numbers of number and date cells). The first used row is the header.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .book import Book
from .xls import OldWorkbook
from .xlsb import BinaryWorkbook
from .xlsx import Workbook


def open_book(path: str) -> Book:
    path = path.removeprefix("file://")
    return {".xls": OldWorkbook, ".xlsb": BinaryWorkbook}.get(Path(path).suffix.lower(), Workbook)(path)


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: int):
        self.path, self.sheet = path, sheet

    def partitions(self):
        return [InputPartition(self.sheet)]

    def read(self, partition):
        book = open_book(self.path)
        header, low = book.shape(partition.value)
        rows = book.rows(partition.value)
        next(rows, None)
        for cells in rows:
            each = [cells.get(low + k, ("", None)) for k in range(len(header))]
            yield (*(t for t, _ in each), *(x for _, x in each))


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "veil_workbook"

    def schema(self) -> str:
        n = len(open_book(self.options["path"]).shape(int(self.options.get("sheet", 0)))[0])
        return ", ".join([*(f"c{i} string" for i in range(n)), *(f"n{i} double" for i in range(n))])

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(self.options["path"], int(self.options.get("sheet", 0)))


def read_sheet(spark: SparkSession, path: str, sheet: int) -> DataFrame:
    spark.dataSource.register(SheetSource)
    return spark.read.format("veil_workbook").option("path", path).option("sheet", sheet).load()
