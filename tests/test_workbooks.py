"""Binary workbooks, from files built here record by record."""

import struct
import zipfile

import pytest

from veilframe.errors import InvalidInputError, UnsupportedFormatError
from veilframe.options import Options
from veilframe.scan import scan
from veilframe.sources.book import packed_number
from veilframe.sources.sheets import open_book, read_sheet
from veilframe.sources.xls import SIGNATURE

HEADER = ["dose", "day", "flag", "note"]
LONG = "é" * 40 + "x" * 9000


def rk(whole=None, hundredths=None):
    return struct.pack("<i", (whole << 2 | 2) if hundredths is None else (hundredths << 2 | 3))


def wide(s):
    return struct.pack("<I", len(s)) + s.encode("utf-16-le")


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def xlsb(path):
    rec = lambda kind, data=b"": varint(kind) + varint(len(data)) + data
    cell = lambda kind, col, value, style=0: rec(kind, struct.pack("<II", col, style) + value)
    row = lambda n: rec(0, struct.pack("<I", n) + bytes(13))
    strings = [*HEADER[:2], LONG]
    sheet = row(1) + cell(7, 1, struct.pack("<I", 0)) + cell(7, 2, struct.pack("<I", 1)) + cell(6, 3, wide("flag")) + cell(8, 4, wide("note"))
    sheet += row(2) + cell(2, 1, rk(1)) + cell(5, 2, struct.pack("<d", 44927.7), 1) + cell(4, 3, b"\1") + cell(7, 4, struct.pack("<I", 2))
    sheet += row(4) + cell(9, 1, struct.pack("<d", 2.5)) + cell(1, 2, b"") + cell(3, 3, b"\x2a") + cell(62, 4, b"\0" + wide("rich"))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.bin", rec(131) + rec(156, struct.pack("<II", 0, 1) + wide("a") + wide("One")) + rec(156, struct.pack("<II", 0, 2) + wide("b") + wide("None")))
        z.writestr("xl/_rels/workbook.bin.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.bin"/><Relationship Id="b" Target="/xl/worksheets/s2.bin"/></Relationships>')
        z.writestr("xl/sharedStrings.bin", b"".join(rec(19, b"\0" + wide(s)) for s in strings))
        z.writestr("xl/styles.bin", rec(44, struct.pack("<H", 170) + wide("yyyy\\-mm")) + rec(47, bytes(16)) + rec(617) + rec(47, bytes(16)) + rec(47, struct.pack("<HH", 0, 170) + bytes(12)) + rec(618))
        z.writestr("xl/worksheets/s1.bin", sheet)
        z.writestr("xl/worksheets/s2.bin", rec(145) + rec(146))
    return str(path)


def compound(path, stream, name="Workbook", small=False):
    """Sectors of 512 bytes: sector 0 the folder, 1 the table of the mini stream, then the stream, then as many tables as that takes."""
    n = -(-len(stream) // 512)
    tables = 1
    while (2 + n + tables) > 128 * tables:
        tables += 1
    nexts = [0xFFFFFFFE, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE, *[0xFFFFFFFD] * tables]
    nexts += [0xFFFFFFFF] * (128 * tables - len(nexts))
    entry = lambda name, kind, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<II", start, size) + bytes(4)
    k = -(-len(stream) // 64)
    mini = [*range(1, k), 0xFFFFFFFE] if small else []
    root = entry("Root Entry", 5, 2 if small else 0xFFFFFFFE, len(stream) if small else 0)
    folder = root + entry(name, 2, 0 if small else 2, len(stream)) + bytes(256)
    head = SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, tables, 0, 0, 4096, 1 if small else 0xFFFFFFFE, int(small), 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *[2 + n + i for i in range(tables)], *[0xFFFFFFFF] * (109 - tables))
    body = folder + struct.pack(f"<{len(mini)}I", *mini).ljust(512, b"\xff") + stream.ljust(512 * n, b"\0")
    path.write_bytes(head + body + struct.pack(f"<{len(nexts)}I", *nexts))
    return str(path)


def xls(path, long=LONG, **how):
    rec = lambda kind, data=b"": struct.pack("<HH", kind, len(data)) + data
    at = lambda row, col, style=0: struct.pack("<HHH", row, col, style)
    text = lambda s: struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")
    bof = rec(0x809, struct.pack("<HH", 0x600, 5) + bytes(12))
    sst = struct.pack("<II", 3, 3) + struct.pack("<HB", 4, 0) + b"dose" + struct.pack("<HBH", 3, 9, 1) + "day".encode("utf-16-le") + bytes(4) + struct.pack("<HB", len(long), 1) + long[:20].encode("utf-16-le")
    rest = long[20:]  # goes on in pieces: wide once more, then a byte a character
    strings = rec(0xFC, sst) + rec(0x3C, b"\1" + rest[:30].encode("utf-16-le")) + b"".join(rec(0x3C, b"\0" + rest[i : i + 8000].encode("latin-1")) for i in range(30, len(rest), 8000))
    inner = rec(0x809, bytes(16)) + rec(0x203, at(9, 9) + struct.pack("<d", 9)) + rec(0x0A)
    one = bof + rec(0xFD, at(1, 1) + struct.pack("<I", 0)) + rec(0xFD, at(1, 2) + struct.pack("<I", 1)) + rec(0x204, at(1, 3) + text("flag")) + rec(6, at(1, 4) + b"\0" * 6 + b"\xff\xff" + bytes(8)) + rec(0x4BC, bytes(8)) + rec(0x207, text("note"))
    one += inner + rec(0xBD, struct.pack("<HH", 2, 1) + struct.pack("<H", 0) + rk(1) + struct.pack("<H", 1) + rk(44927) + struct.pack("<H", 2)) + rec(0x205, at(2, 3) + b"\1\0") + rec(0xFD, at(2, 4) + struct.pack("<I", 2))
    one += rec(0x27E, at(4, 1) + rk(hundredths=250)) + rec(0x201, at(4, 2)) + rec(6, at(4, 3) + b"\2\0\x2a\0\0\0\xff\xff" + bytes(8)) + rec(0x204, at(4, 4) + text("rich")) + rec(0x0A)
    none = bof + rec(0x0A)
    sheet = lambda place, name: rec(0x85, struct.pack("<IBBBB", place, 0, 0, len(name), 0) + name.encode())
    globals_ = lambda a, b: bof + rec(0x41E, struct.pack("<H", 170) + text("yyyy-mm")) + rec(0xE0, bytes(20)) + rec(0xE0, struct.pack("<HH", 0, 170) + bytes(16)) + sheet(a, "One") + sheet(b, "None") + strings + rec(0x0A)
    size = len(globals_(0, 0))
    return compound(path, globals_(size, size + len(one)) + one + none, **how)


@pytest.mark.parametrize("build, name, long", [(xlsb, "w.xlsb", LONG), (xls, "w.xls", LONG), (lambda p: xls(p, "short é" + "y" * 60, small=True), "w.XLS", "short é" + "y" * 60)])
def test_binary_workbook(spark, tmp_path, build, name, long):
    path = build(tmp_path / name)
    book = open_book(path)
    assert [s for s, _ in book.sheets] == ["One", "None"] and book.shape(0) == (HEADER, 1) and book.shape(1) == ([], 0)
    rows = [tuple(r) for r in read_sheet(spark, path, 0).collect()]
    day = 44927.7 if name == "w.xlsb" else 44927.0
    assert rows == [("1", "2023-01-01", "true", long, 1.0, day, None, None), ("",) * 4 + (None,) * 4, ("2.5", "", "#N/A", "rich", 2.5, None, None, None)]
    got = scan(spark, path, Options(bucket_counts=False))
    one, none = got.manifest["sheets"]
    assert got.manifest["format"] == "excel" and [c["dtype"] for c in one["columns"]] == ["numeric", "date", "boolean", "string"]
    assert [(c.count, c.missing) for c in got.tables[0].columns] == [(2, 1), (1, 2), (0, 2), (0, 1)] and none["columns"] == []


def test_packed_numbers():
    value = struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32
    assert [packed_number(x) for x in (value, value | 1, -7 << 2 & 0xFFFFFFFF | 2, 700 << 2 | 3)] == [1.5, 0.015, -7, 7]


def test_what_is_no_workbook(tmp_path):
    for name in ("a.xls", "a.xlsb", "a.xlsx"):
        (tmp_path / name).write_bytes(b"?" * 600)
        with pytest.raises(InvalidInputError):
            open_book(str(tmp_path / name))
    with pytest.raises(UnsupportedFormatError):
        open_book(compound(tmp_path / "old.xls", bytes(5000), "Book"))
    locked = struct.pack("<HH", 0x809, 16) + bytes(16) + struct.pack("<HH", 0x2F, 6) + bytes(5000)
    with pytest.raises(InvalidInputError):
        open_book(compound(tmp_path / "locked.xls", locked))
