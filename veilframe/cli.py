"""python -m veilframe.cli scan --input data.csv"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .errors import VeilError
from .functions.phi import NameLists
from .options import MEDIANS, Options
from .plans.manifest import to_json, write_json
from .plans.spec import spec_options, spec_scan
from .scan import scan


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="veilframe")
    sub = out.add_subparsers(dest="command", required=True)
    one = sub.add_parser("scan", help="profile a file")
    one.add_argument("-i", "--input", required=True)
    one.add_argument("-o", "--out", help="JSON file; standard output without it")
    one.add_argument("-k", "--k", type=int, help="least number of rows a value that is listed has (5; with --spec 20, relaxed 10)")
    for name, default in (("bucket-counts", True), ("exact-counts", False), ("exact-median", False), ("hash-file", True), ("relaxed", False)):
        one.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=default)
    one.add_argument("--median", choices=MEDIANS, default="p2")
    one.add_argument("--spec", action="store_true", help="write the document of the published JSON Schema")
    one.add_argument("--recode-key", action=argparse.BooleanOptionalAction, default=True, help="write the key of the labels beside the input")
    one.add_argument("--surnames", help="text file, a name a line")
    one.add_argument("--first-names", help="text file, a name a line")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if bool(args.surnames) != bool(args.first_names):
        print("Error: --surnames and --first-names are given together", file=sys.stderr)
        return 2
    k = args.k if args.k is not None else spec_options(args.relaxed).k if args.spec else Options().k
    options = Options(k=k, bucket_counts=args.bucket_counts, exact_counts=args.exact_counts, exact_median=args.exact_median, hash_file=args.hash_file, relaxed=args.relaxed, median=args.median)
    names = NameLists.read(args.surnames, args.first_names) if args.surnames and args.first_names else None
    try:
        if args.spec:
            doc, key = spec_scan(spark, args.input, options, names), None
        else:
            got = scan(spark, args.input, options, names)
            doc, key = got.manifest, got.recode_key
    except VeilError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    if key and args.recode_key:
        Path(args.input.removeprefix("file://")).with_suffix(".recode.txt").write_text(key, encoding="utf-8")
    if args.out:
        write_json(doc, args.out)
    else:
        print(to_json(doc))
    return 0


if __name__ == "__main__":
    sys.exit(main())
