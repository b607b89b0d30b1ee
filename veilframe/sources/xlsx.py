"""Workbooks of XML parts (.xlsx, .xlsm); rows are streamed."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from ..errors import InvalidInputError
from .book import DATE_FORMATS, Book, Cell, shows_date


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def part_name(target: str) -> str:
    """The name in the archive of what a relationship of the workbook points to."""
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def column_index(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


class Workbook(Book):
    def __init__(self, path: str):
        if not zipfile.is_zipfile(path):
            raise InvalidInputError(f"{path} is no .xlsx or .xlsm workbook")
        self.zip = zipfile.ZipFile(path)
        rels = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels")}
        book = self._tree("xl/workbook.xml")
        self.sheets = []
        for s in (x for x in book.iter() if _local(x.tag) == "sheet"):
            self.sheets.append((s.get("name"), part_name(rels[next(v for k, v in s.attrib.items() if _local(k) == "id")])))
        self.strings = self._strings() if "xl/sharedStrings.xml" in self.zip.namelist() else []
        self.dates = self._dates() if "xl/styles.xml" in self.zip.namelist() else set()

    def _tree(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _strings(self) -> list[str]:
        return ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in self._tree("xl/sharedStrings.xml")]

    def _dates(self) -> set[int]:
        root = self._tree("xl/styles.xml")
        own = {int(x.get("numFmtId")) for x in root.iter() if _local(x.tag) == "numFmt" and shows_date(x.get("formatCode", ""))}
        xfs = next((x for x in root.iter() if _local(x.tag) == "cellXfs"), [])
        return {i for i, xf in enumerate(xfs) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | own}

    def _cell(self, c) -> Cell:
        kind, value = c.get("t", "n"), next((x.text or "" for x in c if _local(x.tag) == "v"), None)
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t"), None
        if value is None:
            return "", None
        if kind == "s":
            return self.strings[int(value)], None
        if kind == "b":
            return "true" if value == "1" else "false", None
        if kind in ("str", "d"):
            return value, None
        if kind == "e":
            return value if value.startswith("#") else f"#{value}", None
        return self.number(float(value), int(c.get("s", 0)))

    def numbered_rows(self, index: int) -> Iterator[tuple[int, dict[int, Cell]]]:
        with self.zip.open(self.sheets[index][1]) as file:
            for _, node in ElementTree.iterparse(file):
                if _local(node.tag) != "row":
                    continue
                cells, at = {}, 0
                for c in node:
                    at = column_index(c.get("r")) if c.get("r") else at
                    if (got := self._cell(c)) != ("", None):
                        cells[at] = got
                    at += 1
                number = int(node.get("r", 0))
                node.clear()
                yield number, cells
