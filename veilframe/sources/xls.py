"""Workbooks of Excel 97 to 2003 (.xls): one stream of records in a compound file.

Such a sheet has at most 65,536 rows of 256 columns; it is read whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..errors import InvalidInputError, UnsupportedFormatError
from .book import DATE_FORMATS, ERRORS, Book, Cell, packed_number, shows_date

#: The signature of compound files, the first sector number that is none, record numbers.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
SPECIAL = 0xFFFFFFFA
FORMULA, END, CONTINUE, SHEET, PASSWORD, STYLE, MANY_RK, RICH, STRINGS, SHARED = 0x06, 0x0A, 0x3C, 0x85, 0x2F, 0xE0, 0xBD, 0xD6, 0xFC, 0xFD
NUMBER, LABEL, BOOL_OR_ERROR, FORMULA_TEXT, RK, NUMBER_FORMAT, BEGIN = 0x203, 0x204, 0x205, 0x207, 0x27E, 0x41E, 0x809


class CompoundFile:
    """The streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE:
            raise InvalidInputError("no compound file")
        self.data = data
        self.shift, small = struct.unpack_from("<HH", data, 30)
        n_tables, folder = struct.unpack_from("<II", data, 44)
        self.least, small_start, _, more = struct.unpack_from("<4I", data, 56)
        tables = [s for s in struct.unpack_from("<109I", data, 76) if s < SPECIAL]
        seen = set()
        while more < SPECIAL and more not in seen:
            seen.add(more)
            *here, more = struct.unpack(f"<{(1 << self.shift) // 4}I", self._sector(more))
            tables += [s for s in here if s < SPECIAL]
        self.next = self._numbers(b"".join(map(self._sector, tables[:n_tables])))
        entries = self._chain(folder)
        self.small_shift, self.small_next = small, self._numbers(self._chain(small_start))
        self.streams, self.small = {}, b""
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            start, size = struct.unpack_from("<II", entries, at + 116)
            if kind == 5:
                self.small = self._chain(start)
            elif kind == 2:
                self.streams[entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")] = (start, size)

    @staticmethod
    def _numbers(data: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4])

    def _sector(self, i: int) -> bytes:
        return self.data[(i + 1) << self.shift : (i + 2) << self.shift].ljust(1 << self.shift, b"\0")

    def _chain(self, start: int) -> bytes:
        parts, seen = [], set()
        while start < len(self.next) and start not in seen:
            seen.add(start)
            parts.append(self._sector(start))
            start = self.next[start]
        return b"".join(parts)

    def stream(self, name: str) -> bytes:
        start, size = self.streams[name]
        if size >= self.least:
            return self._chain(start)[:size]
        parts, seen = [], set()
        while start < len(self.small_next) and start not in seen:
            seen.add(start)
            parts.append(self.small[start << self.small_shift : (start + 1) << self.small_shift])
            start = self.small_next[start]
        return b"".join(parts)[:size]


class Pieces:
    """Reads a record and those that continue it as one."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.k, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.pieces):
            got = self.pieces[self.k][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if self.at >= len(self.pieces[self.k]) and n:
                self.k, self.at = self.k + 1, 0
        return out

    def characters(self, n: int, wide: bool) -> str:
        """A piece that goes on within a string tells anew in its first byte how wide characters are."""
        out = []
        while n and self.k < len(self.pieces):
            width = 2 if wide else 1
            got = self.pieces[self.k][self.at : self.at + n * width]
            out.append(got.decode("utf-16-le" if wide else "latin-1", "surrogatepass"))
            n, self.at = n - len(got) // width, self.at + len(got)
            if n:
                self.k, self.at = self.k + 1, 0
                wide = bool(self.take(1)[0] & 1) if self.k < len(self.pieces) else wide
        return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    def text(self, length_bytes: int = 2) -> str:
        n, flags = int.from_bytes(self.take(length_bytes), "little"), int.from_bytes(self.take(1), "little")
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        out = self.characters(n, bool(flags & 1))
        self.take(4 * runs + extra)
        return out


class OldWorkbook(Book):
    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        if data[:8] != SIGNATURE:
            raise InvalidInputError(f"{path} is no .xls workbook")
        found = CompoundFile(data)
        name = next((n for n in found.streams if n.lower() == "workbook"), None)
        if name is None:
            raise UnsupportedFormatError(f"{path} has no workbook of Excel 97 or later")
        self.data = found.stream(name)
        self.sheets, self.strings, formats, styles = [], [], set(DATE_FORMATS), []
        for kind, pieces in self._records(0):
            first = pieces[0]
            if kind == PASSWORD:
                raise InvalidInputError(f"{path} is encrypted")
            if kind == SHEET and first[5] == 0:
                self.sheets.append((Pieces([first[6:]]).text(1), struct.unpack_from("<I", first)[0]))
            elif kind == STRINGS:
                reader = Pieces([first[8:], *pieces[1:]])
                self.strings = [reader.text() for _ in range(struct.unpack_from("<I", first, 4)[0])]
            elif kind == NUMBER_FORMAT and shows_date(Pieces([first[2:], *pieces[1:]]).text()):
                formats.add(struct.unpack_from("<H", first)[0])
            elif kind == STYLE:
                styles.append(struct.unpack_from("<H", first, 2)[0])
        self.dates = {i for i, f in enumerate(styles) if f in formats}

    def _records(self, at: int) -> Iterator[tuple[int, list[bytes]]]:
        """Records of the part that begins there, with what continues them; parts within it are left out."""
        depth, held = 0, None
        while at + 4 <= len(self.data):
            kind, size = struct.unpack_from("<HH", self.data, at)
            body, at = self.data[at + 4 : at + 4 + size], at + 4 + size
            if kind == CONTINUE:
                if held:
                    held[1].append(body)
                continue
            if held:
                yield held
            held = None
            depth += (kind == BEGIN) - (kind == END)
            if depth <= 0:
                return
            if depth == 1:
                held = (kind, [body])

    def _cells(self, index: int) -> Iterator[tuple[int, int, Cell]]:
        waiting = None
        for kind, pieces in self._records(self.sheets[index][1]):
            data = pieces[0]
            if kind == FORMULA_TEXT and waiting:
                yield *waiting, (Pieces(pieces).text(), None)
                waiting = None
            if kind not in (FORMULA, MANY_RK, RICH, SHARED, NUMBER, LABEL, BOOL_OR_ERROR, RK):
                continue
            row, col, style = struct.unpack_from("<HHH", data)
            waiting = None
            if kind == SHARED:
                yield row, col, (self.strings[struct.unpack_from("<I", data, 6)[0]], None)
            elif kind in (LABEL, RICH):
                yield row, col, (Pieces([data[6:], *pieces[1:]]).text(), None)
            elif kind == NUMBER or (kind == FORMULA and data[12:14] != b"\xff\xff"):
                yield row, col, self.number(struct.unpack_from("<d", data, 6)[0], style)
            elif kind == RK:
                yield row, col, self.number(packed_number(struct.unpack_from("<I", data, 6)[0]), style)
            elif kind == MANY_RK:
                for k in range((len(data) - 6) // 6):
                    style, rk = struct.unpack_from("<HI", data, 4 + 6 * k)
                    yield row, col + k, self.number(packed_number(rk), style)
            else:  # of a formula: 0 text that follows, 1 truth, 2 error, 3 nothing
                what, value = (data[6], data[8]) if kind == FORMULA else (1 + data[7], data[6])
                if what == 0:
                    waiting = row, col
                elif what in (1, 2):
                    yield row, col, ((ERRORS.get(value, "#N/A") if what == 2 else "true" if value else "false"), None)

    def numbered_rows(self, index: int) -> Iterator[tuple[int, dict[int, Cell]]]:
        found: dict[int, dict[int, Cell]] = {}
        for row, col, cell in self._cells(index):
            if cell != ("", None):
                found.setdefault(row, {})[col] = cell
        for row in sorted(found):
            yield row + 1, found[row]
