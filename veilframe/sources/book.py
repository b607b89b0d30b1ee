"""What all workbook formats share: rows without gaps, the header, numbers and dates as text."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import date, timedelta

EPOCH = date(1899, 12, 30)
#: The built-in number formats that show dates, and the texts of error codes in binary workbooks.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}

Cell = tuple[str, float | None]
"""A cell's text, and its number if it is a number or a date."""


def serial_to_date(serial: float) -> str:
    """Whole days since the epoch of workbooks; the time of day is dropped. A serial beyond the calendar stays a number."""
    try:
        return (EPOCH + timedelta(days=int(serial))).isoformat()
    except (OverflowError, ValueError):
        return number_text(serial)


def number_text(x: float) -> str:
    """Whole numbers without a point."""
    return str(int(x)) if abs(x) < 1e16 and x == int(x) else repr(x)


def shows_date(code: str) -> bool:
    """Whether a number format has a part of a date or time, outside quotes, brackets and escapes."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))


def packed_number(rk: int) -> float:
    """A number in 30 bits: a whole number or the upper part of a double, perhaps in hundredths."""
    x = float((rk - (1 << 32) if rk >> 31 else rk) >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return x / 100 if rk & 1 else x


class Book:
    """sheets: names and places. dates: the style numbers that show a number as a date."""

    sheets: list[tuple[str, object]]
    dates: set[int]

    def numbered_rows(self, index: int) -> Iterator[tuple[int, dict[int, Cell]]]:
        """Row numbers (ascending; 0 if not told) and their cells by column, without empty cells."""
        raise NotImplementedError

    def number(self, x: float, style: int) -> Cell:
        return (serial_to_date(x) if style in self.dates else number_text(x)), x

    def rows(self, index: int) -> Iterator[dict[int, Cell]]:
        """Cells by column, row by row, from the first used row; rows that the file leaves out between others are empty."""
        last = None
        for number, cells in self.numbered_rows(index):
            if last is None and not cells:
                continue
            for _ in range(number - last - 1 if last is not None and number else 0):
                yield {}
            last = number
            yield cells

    def shape(self, index: int) -> tuple[list[str], int]:
        """Header and first used column of a sheet."""
        low, high, head = None, -1, None
        for cells in self.rows(index):
            head = cells if head is None else head
            for k in cells:
                low, high = k if low is None else min(low, k), max(high, k)
        if head is None or low is None:
            return [], 0
        return [head.get(k, ("", None))[0] for k in range(low, high + 1)], low
