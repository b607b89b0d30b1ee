"""The stricter document of the published build specification and its JSON Schema.

Values come with their counts, and only for columns of at most CATEGORIES
values of which every one occurs k times or more; small tables show no statistics; dates
have ranges; short strings must look like codes or words.
"""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.columns import check_name
from ..functions.phi import NameLists
from ..functions.scalars import bucket_name
from ..operators import frequencies as fr
from ..operators.cells import Cell, cells_of, free_name, long_form
from ..operators.jobs import WIDE, at_once, in_parts
from ..options import Options
from .profile import WIDE_TEXT, medians_of, profile

CATEGORIES = 10
K = 20
RELAXED_K = 10
EXACT_MEDIAN_ROWS = 2_000_000
WORDY_BYTES = 50
MOST_BAD_NUMBERS = 0.05
#: Fixed value: the document's warning.
WARNING = "Review this schema before sharing. Ensure no PHI is present."

#: Parts of column names that flag a risk; id warns but doesn't block.
RISKY = ("name", "patient", "subject_name", "mrn", "medical_record", "ssn", "social_security", "dob", "birth", "birthday", "address", "street", "city", "zip", "postal", "phone", "email", "contact", "provider", "physician", "nurse", "doctor", "site", "hospital", "clinic", "facility")
#: Names whose columns may not list plain words.
NO_WORDS = ("provider", "site", "name", "hospital", "physician", "nurse")

#: Patterns looked for anywhere in a value.
ANYWHERE = (
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", r"\d{3}[-.]?\d{3}[-.]?\d{4}|\+\d{1,3}[-. ]?\d{1,4}([-. ]?\d{2,4}){2,4}"),
    ("postal", r"\b\d{5}(-\d{4})?\b|\b[A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d\b"),
    ("long_id", r"(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{10,}"),
)
#: Fixed value: words that may always be listed.
BOOLEANISH = r"(?i)^(yes|no|y|n|true|false|0|1|male|female|m|f)$"


def spec_options(relaxed: bool = False) -> Options:
    return Options(k=RELAXED_K if relaxed else K, relaxed=relaxed, exact_counts=relaxed, exact_median=relaxed)


def found_anywhere(v):
    """The first kind of personal data in a value, or null; dates count."""
    t = s.trim(v)
    out = F.when(s.is_date(t) | s.is_datetime(t), "date")
    for kind, pattern in reversed(ANYWHERE):
        out = F.when(v.rlike(pattern), kind).otherwise(out)
    return out


def category_counts(freq: DataFrame, most: int = CATEGORIES) -> DataFrame:
    """col_idx, values (array of value, n) of columns with at most that many values: no list grows beyond it."""
    few = fr.distinct_counts(freq).where(F.col("n_distinct") <= most)
    return freq.join(F.broadcast(few), "col_idx").groupBy("col_idx").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("values"))


def small_cells(counts, rows: int, k: int) -> str | None:
    """Why values with these counts can't be listed whatever they are, or None."""
    return "n_rows < k" if rows < k else "small cells (count < k)" if any(n < k for n in counts) else None


def string_block(values: list[tuple[str, int]], header: str, kinds: list[str | None]) -> str | None:
    """Why a short-string column can't be listed, or None. Shares are of rows."""
    total = sum(n for _, n in values) or 1
    words = not any(x in header.lower() for x in NO_WORDS)
    plain = sum(n for v, n in values if re.search(r"^[0-9]+$", v) or re.search(BOOLEANISH, v) or words and re.search(r"^[A-Za-z]{1,20}$", v))
    mixed = sum(n for v, n in values if re.search(r"[A-Za-z]", v) and re.search(r"\d", v))
    if any(len(v) > 32 for v, _ in values):
        return "values longer than 32 characters"
    if kind := next((k for k in kinds if k), None):
        return f"values match {kind} pattern"
    if plain < 0.8 * total:
        return "fewer than 80% of values match an allowed pattern"
    if mixed > 0.3 * total:
        return "more than 30% of values mix letters and digits"
    return None


def _rule(x):
    return F.lit(x) if isinstance(x, bool) else x


def spec_sheet(df: DataFrame, name: str, index: int, options: Options, names: NameLists | None = None, headers: list[str] | None = None, workbook: bool = False, **kwargs) -> tuple[dict, list[str], list[str]]:
    """One sheet, its risky columns and those whose values were withheld."""
    names, k, bucketed = names or NameLists.of(), options.k, options.bucketed
    base = profile(df, replace(options, median="none", exact_median=False, count_text=True, phi_stats=True), names, headers, workbook=workbook, **kwargs)
    cols = kwargs.get("columns") or df.columns
    cells = cells_of(df, headers, kwargs.get("present"), kwargs.get("numbers"), cols)
    count = (lambda n: bucket_name(n)) if bucketed else (lambda n: n)
    method = "exact" if options.median_method == "exact" and base.rows <= EXACT_MEDIAN_ROWS else "p2_approx"
    place = free_name(df.columns, "row")
    medians = medians_of(df.withColumn(place, F.monotonically_increasing_id()), [c for c in cells if c.number is not None], F.col(place), replace(options, median="exact" if method == "exact" else "p2", exact_median=False))

    def facts(c: Cell) -> list:
        """Only what the types of cells leave open: dates and serials have no part in most columns."""
        t, own, k = s.trim(c.text), c.filled, c.index
        out = [F.avg(F.when(own, (~_rule(c.numeric)).cast("int"))).alias(f"bad_{k}"), F.avg(F.when(own, F.length(c.text))).alias(f"size_{k}")]
        if base.columns[k].dtype == "date":
            out += [F.min(F.when(own, s.parse_date(t))).alias(f"d0_{k}"), F.max(F.when(own, s.parse_date(t))).alias(f"d1_{k}")]
        if base.columns[k].dtype == "datetime":
            stamp = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, "T", " "), "Z$", ""))
            out += [F.min(F.when(own & _rule(c.datetime), stamp)).alias(f"t0_{k}"), F.max(F.when(own & _rule(c.datetime), stamp)).alias(f"t1_{k}")]
        if workbook:
            x = F.when(own, c.number if c.number is not None else F.lit(None).cast("double"))
            out.append(F.bool_and(F.when(own, F.coalesce(x.between(1, 2958465) & (x == F.floor(x)), F.lit(False)))).alias(f"serial_{k}"))
        return out

    got: dict = {}
    for found in at_once(df.sparkSession, [lambda some=some: df.agg(F.count(F.lit(1)), *[f for c in some for f in facts(c)]).first().asDict() for some in in_parts(cells, kwargs.get("wide", WIDE))]):
        got |= found
    few = [c for c in cells if (n := base.columns[c.index].n_distinct) is not None and n <= CATEGORIES]
    lists: dict[int, list[tuple[str, int]]] = {}
    if few:
        freq = long_form(df, few).groupBy("col_idx", "value").agg(F.count(F.lit(1)).alias("n"))
        lists = {r["col_idx"]: [(v["value"], v["n"]) for v in r["values"]] for r in category_counts(freq).collect()}
    kinds = {}
    if texts := sorted({v for x in lists.values() for v, _ in x}):
        local = df.sparkSession.createDataFrame([(v,) for v in texts], "v string")
        kinds = {r["v"]: r["kind"] for r in local.select("v", found_anywhere(F.col("v")).alias("kind")).collect()}
    columns, risky, withheld = [], [], []
    for c in base.columns:
        i, plain = c.index, re.sub(r"[- .]", "_", c.header.lower())
        risk = c.classification in ("phi", "recode") or any(re.search(rf"(^|_){x}(_|$)", plain) for x in RISKY)
        dtype = c.dtype
        if dtype == "string" and c.non_missing and got[f"bad_{i}"] <= MOST_BAD_NUMBERS:
            dtype = "numeric"
        capped = c.n_distinct is None
        many = capped or c.n_distinct > CATEGORIES
        if dtype == "string" and (many or (got[f"size_{i}"] or 0) > WORDY_BYTES):
            dtype = "free_text"
        number = dtype in ("integer", "numeric")
        kind = dtype if dtype in ("date", "datetime") else "free_text_excluded" if dtype == "free_text" else "continuous" if number and many else "high_cardinality" if many else "categorical"
        n_unique = options.cap if capped else c.n_distinct
        one = {"name": c.header or f"Column{i + 1}", "dtype": dtype, "unique_count": count(n_unique), "unique_count_capped": capped, "missing_count": count(c.missing), "classification": kind}
        if capped:
            one["unique_count_note"] = f"Tracking capped at {options.cap}; true cardinality >= {options.cap}"
        values, reason = lists.get(i, []), None
        if kind != "categorical":
            reason = f"{kind} columns are not listed"
        elif base.rows < k:
            reason = small_cells((), base.rows, k)
        elif risk:
            reason = "column name suggests PHI"
        elif reason := small_cells((n for _, n in values), base.rows, k):
            pass
        elif dtype == "string":
            reason = string_block(values, c.header, [kinds.get(v) or ("name" if names.likely(v) else None) for v, _ in values])
        one["exported_values"] = reason is None
        if reason is None:
            as_value = {"integer": int, "numeric": float}.get(dtype, str)
            one["values"] = [{"value": as_value(v), "count": count(n)} for v, n in values]
        else:
            one["suppression_reason"] = reason
            withheld.append(one["name"])
        if kind == "continuous":
            if base.rows < k:
                one |= {"stats_suppressed": True, "suppression_reason": "n_rows < k; statistics suppressed to protect privacy"}
            else:
                one["stats"] = {"min": c.min, "max": c.max, "mean": c.mean, "median": medians.get(i), "median_method": method, "median_ci": None, "median_note": None if method == "exact" else "Approximate; do not cite for publication"}
        if kind in ("date", "datetime"):
            a, b = ("d0", "d1") if kind == "date" else ("t0", "t1")
            show = base.rows >= k and not risk
            one["range"] = {"min": got[f"{a}_{i}"].isoformat(), "max": got[f"{b}_{i}"].isoformat()} if show and got[f"{a}_{i}"] else {"range_present": bool(c.non_missing)}
        if workbook and number and c.non_missing:
            one["possible_date"] = bool(got[f"serial_{i}"])
        if risk:
            one["phi_warning"] = c.warning or check_name(c.header).warning or "Column name suggests PHI"
            risky.append(one["name"])
        columns.append(one)
    out = {"sheet_name": name, "sheet_index": index, "total_rows": count(base.rows), "total_columns": len(columns), "columns": columns}
    if not bucketed:
        out["total_rows_exact"] = base.rows
    return out, risky, withheld


def document(name: str, kind: str, sheets: list[tuple[dict, list[str], list[str]]], options: Options, digest: str | None = None, now: str | None = None) -> dict:
    """median_method is exact only if that of every column is: a sheet of over EXACT_MEDIAN_ROWS rows has estimates."""
    used = {c["stats"]["median_method"] for x, *_ in sheets for c in x["columns"] if "stats" in c}
    method = "exact" if options.median_method == "exact" and used <= {"exact"} else "p2_approx"
    return {
        "manifest_version": "1.0.0", "generated_at": now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "warning": WARNING,
        "privacy": {"k": options.k, "counts": "bucketed" if options.bucketed else "exact", "export_categorical_values": "safe_only", "median_method": method},
        "missing_tokens": list(s.MISSING), "phi_risk_columns": list(dict.fromkeys(x for _, r, _ in sheets for x in r)), "suppressed_columns": list(dict.fromkeys(x for *_, w in sheets for x in w)),
        "source_file": name, "source_file_sha256": digest, "file_type": kind, "sheets": [x for x, *_ in sheets],
    }


def spec_scan(spark: SparkSession, path: str, options: Options | None = None, names: NameLists | None = None) -> dict:
    from ..sources.detect import format_of, sha256_of

    options, kind = options or spec_options(), format_of(path)
    sheets = []
    if kind == "excel":
        from ..sources.sheets import open_book, read_sheet

        book = open_book(path)
        for i, (name, _) in enumerate(book.sheets):
            header, _ = book.shape(i)
            n = len(header)
            sheets.append(spec_sheet(read_sheet(spark, path, i), name, i, options, names, header, True, numbers={f"c{k}": f"n{k}" for k in range(n)}, columns=[f"c{k}" for k in range(n)], wide=WIDE_TEXT) if header else empty_sheet(name, i, options))
    else:
        from ..sources.text import RAW, check_utf8, read_text

        check_utf8(spark, path)
        df, header, present = read_text(spark, path, "\t" if kind == "tsv" else ",")
        sheets.append(spec_sheet(df, Path(path).name, 0, options, names, header, present=present, columns=[c for c in df.columns if c != RAW], wide=WIDE_TEXT) if header else empty_sheet(Path(path).name, 0, options))
    return document(Path(path).name, kind, sheets, options, sha256_of(path, spark=spark) if options.hash_file else None)


def empty_sheet(name: str, index: int, options: Options) -> tuple[dict, list[str], list[str]]:
    out = {"sheet_name": name, "sheet_index": index, "total_rows": "0" if options.bucketed else 0, "total_columns": 0, "columns": []}
    return out if options.bucketed else out | {"total_rows_exact": 0}, [], []


def write_spec(doc: dict, path: str | Path) -> Path:
    """Beside the input, as {name}_schema.json."""
    from .manifest import write_json

    out = Path(path).with_name(f"{Path(path).stem}_schema.json")
    write_json(doc, out)
    return out
