"""The shareable document: profiles of a file's sheets as JSON."""

from __future__ import annotations

import json
import math
from pathlib import Path

from ..options import Options
from .profile import HIGH, TableProfile, safe_count

VERSION = "1.0.0"


def _suppressed(reason: str) -> dict:
    return {"type": "Suppressed", "value": {"reason": reason}}


def short_string(text: str, reason: str, longest: int = 32) -> dict:
    return {"type": "ShortString", "value": text} if len(text.encode()) <= longest else _suppressed(reason)


def _finite(x: float | None) -> float | None:
    return x if x is not None and math.isfinite(x) else None


def sheet(name: str, index: int, table: TableProfile, options: Options) -> dict:
    """One table; an empty one (no columns) has an exact row count of 0."""
    if not table.columns:
        return {"name": name, "index": index, "row_count": {"type": "Integer", "value": 0}, "columns": []}
    columns = []
    for c in table.columns:
        phi = c.classification == "phi"
        stats: dict = {"count": safe_count(c.count, options.bucketed), "missing_count": safe_count(c.missing, options.bucketed)}
        for key in ("min", "max"):
            if (x := getattr(c, key)) is not None:
                stats[key] = {"type": "Float", "value": _finite(float(x))}
        for key in ("mean", "std_dev", "median"):
            if (x := getattr(c, key)) is not None:
                stats[key] = _finite(float(x))
        if c.n_distinct is None:
            stats["unique_count"] = _suppressed("High cardinality; exact count suppressed")
        else:
            stats["unique_count"] = safe_count(c.n_distinct, options.bucketed)
        one = {"name": _suppressed("Column name matches PHI pattern") if phi else short_string(c.header, "Column name too long", options.longest), "index": c.index, "dtype": c.dtype, "classification": c.classification, "stats": stats}
        if c.values:
            one["unique_values"] = [{"type": "ShortString", "value": v} for v in c.values]
        if c.warning:
            one["warnings"] = [c.warning]
        columns.append(one)
    return {"name": name, "index": index, "row_count": safe_count(table.rows, options.bucketed), "columns": columns}


def manifest(file_name: str, kind: str, sheets: list[dict], options: Options, file_hash: str | None = None) -> dict:
    warnings = dict.fromkeys(f"Sheet '{s['name']}', Column {c['index'] + 1}: {w}" for s in sheets for c in s["columns"] for w in c.get("warnings", ()))
    out: dict = {"version": VERSION, "file_name": file_name}
    if file_hash:
        out["file_hash"] = file_hash
    out |= {"format": kind, "sheets": sheets}
    if warnings:
        out["warnings"] = list(warnings)
    return out | {"options": options.public()}


def all_warnings(doc: dict) -> list[str]:
    """Those of the document, of its sheets and of their columns."""
    return [*doc.get("warnings", []), *(w for s in doc["sheets"] for w in s.get("warnings", [])), *(w for s in doc["sheets"] for c in s["columns"] for w in c.get("warnings", []))]


def to_json(doc: dict) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False, allow_nan=False)


def write_json(doc: dict, path: str | Path) -> None:
    Path(path).write_text(to_json(doc) + "\n", encoding="utf-8")


__all__ = ["HIGH", "all_warnings", "manifest", "sheet", "short_string", "to_json", "write_json"]
