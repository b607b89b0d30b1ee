"""Workbooks of binary parts (.xlsb); rows are streamed."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from ..errors import InvalidInputError
from .book import DATE_FORMATS, ERRORS, Book, Cell, packed_number, shows_date
from .xlsx import part_name

#: Record numbers of the format.
ROW, RK, ERROR, BOOL, REAL, TEXT, SHARED, F_TEXT, F_REAL, F_BOOL, F_ERROR, RICH = 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 62
STRING_ITEM, NUMBER_FORMAT, STYLE, SHEET, CELL_STYLES, CELL_STYLES_END = 19, 44, 47, 156, 617, 618


def _varint(file, most: int) -> int | None:
    """Seven bits a byte, lowest first, while the high bit is set; None at the end of the file."""
    value = 0
    for k in range(most):
        byte = file.read(1)
        if not byte:
            return None
        value |= (byte[0] & 127) << 7 * k
        if byte[0] < 128:
            break
    return value


def records(file) -> Iterator[tuple[int, bytes]]:
    """Record numbers and contents."""
    while (kind := _varint(file, 2)) is not None and (size := _varint(file, 4)) is not None:
        yield kind, file.read(size)


def wide(data: bytes, at: int) -> tuple[str, int]:
    """A string with its length before it, and where it ends."""
    (n,) = struct.unpack_from("<I", data, at)
    if n == 0xFFFFFFFF:
        return "", at + 4
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


class BinaryWorkbook(Book):
    def __init__(self, path: str):
        if not zipfile.is_zipfile(path) or "xl/workbook.bin" not in (z := zipfile.ZipFile(path)).namelist():
            raise InvalidInputError(f"{path} is no .xlsb workbook")
        self.zip, self.sheets = z, []
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.bin.rels"))}
        for kind, data in self._part("xl/workbook.bin"):
            if kind == SHEET:
                rel, end = wide(data, 8)
                self.sheets.append((wide(data, end)[0], part_name(rels[rel])))
        self.strings = [wide(data, 1)[0] for kind, data in self._part("xl/sharedStrings.bin") if kind == STRING_ITEM]
        self.dates = self._dates()

    def _part(self, name: str) -> Iterator[tuple[int, bytes]]:
        if name in self.zip.namelist():
            with self.zip.open(name) as file:
                yield from records(io.BufferedReader(file, 1 << 16))

    def _dates(self) -> set[int]:
        formats, styles, inside = set(DATE_FORMATS), [], False
        for kind, data in self._part("xl/styles.bin"):
            if kind == NUMBER_FORMAT and shows_date(wide(data, 2)[0]):
                formats.add(struct.unpack_from("<H", data)[0])
            elif kind in (CELL_STYLES, CELL_STYLES_END):
                inside = kind == CELL_STYLES
            elif kind == STYLE and inside:
                styles.append(struct.unpack_from("<H", data, 2)[0])
        return {i for i, f in enumerate(styles) if f in formats}

    def _cell(self, kind: int, data: bytes) -> Cell | None:
        """Column and style take the first eight bytes."""
        style = int.from_bytes(data[4:7], "little")
        if kind == RK:
            return self.number(packed_number(struct.unpack_from("<I", data, 8)[0]), style)
        if kind in (REAL, F_REAL):
            return self.number(struct.unpack_from("<d", data, 8)[0], style)
        if kind == SHARED:
            return self.strings[struct.unpack_from("<I", data, 8)[0]], None
        if kind in (TEXT, F_TEXT):
            return wide(data, 8)[0], None
        if kind == RICH:
            return wide(data, 9)[0], None
        if kind in (BOOL, F_BOOL):
            return "true" if data[8] else "false", None
        return (ERRORS.get(data[8], "#N/A"), None) if kind in (ERROR, F_ERROR) else None

    def numbered_rows(self, index: int) -> Iterator[tuple[int, dict[int, Cell]]]:
        number, cells = None, {}
        for kind, data in self._part(self.sheets[index][1]):
            if kind == ROW:
                if number is not None:
                    yield number, cells
                number, cells = struct.unpack_from("<I", data)[0] + 1, {}
            elif number is not None and len(data) > 8 and (got := self._cell(kind, data)) not in (None, ("", None)):
                cells[struct.unpack_from("<I", data)[0]] = got
        if number is not None:
            yield number, cells
