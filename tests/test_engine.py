"""The profiling engine: rules, inference against a row-by-row version, readers, manifests, spec mode, streams."""

import hashlib
import json
import random
import statistics
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from veilframe import InvalidInputError, Options, UnsupportedFormatError, cli
from veilframe.functions import columns, phi
from veilframe.functions import scalars as s
from veilframe.operators import infer, recode
from veilframe.operators.p2 import p2_by_column, p2_quantile
from veilframe.plans import manifest as mf
from veilframe.plans import spec
from veilframe.plans.profile import as_frame, profile
from veilframe.plans.schema_check import problems
from veilframe.scan import scan, scan_frame
from veilframe.sources.detect import format_of, sha256_of
from veilframe.sources.book import serial_to_date
from veilframe.sources.xlsx import Workbook, column_index
from veilframe.sql import register
from veilframe.streaming.profile import Moments, RunningProfile, windowed_counts


def test_buckets_and_labels(spark):
    want = {0: "0", 1: "1", 2: "2-5", 5: "2-5", 6: "6-10", 10: "6-10", 11: "11-20", 20: "11-20", 21: "21-100", 100: "21-100", 101: "101-1000", 1000: "101-1000", 1001: ">1000"}
    assert {n: s.bucket_name(n) for n in want} == want
    rows = spark.createDataFrame([(n,) for n in (0, 1, 25, 26, 27, 51, 52, 701, 702, 18278)], "n long").select("n", s.index_to_label(F.col("n")).alias("l"), s.bucket_count(F.col("n")).alias("b")).collect()
    assert [r["l"] for r in rows] == ["A", "B", "Z", "AA", "AB", "AZ", "BA", "ZZ", "AAA", "AAAA"] == [s.label_name(r["n"]) for r in rows]
    assert all(r["b"] == s.bucket_name(r["n"]) for r in rows)


def test_values(spark):
    cases = {"a@b.co": "email", "555-123-4567": "phone", "123-45-6789": "ssn", "12345": "zip", "V6T 1Z4": "postal", "ABC1234567": "long_id", "https://a.b": "url", "1.2.3.4": "ipv4", "::1": "ipv6", "00:1A:2B:3C:4D:5E": "mac_address", "Male": None, "42": None, "123456789012": None, "12345\n": "zip"}
    got = spark.createDataFrame([(v,) for v in cases], "v string").select("v", phi.pattern_kind(F.col("v")).alias("k")).collect()
    assert {r["v"]: r["k"] for r in got} == cases


def test_names():
    names = phi.NameLists.of()
    for v in ("Smith", "JOHNSON", "silva", "Wei", "Jean-Pierre", "CÔTÉ", "João Silva", "Mary Q Smith", "Unknown Garcia"):
        assert names.likely(v), v
    for v in ("Treatment", "Control", "42", "ABCD1234", "X", "", None, "Foo 12 Smith", "a b c d"):
        assert not names.likely(v), v


@pytest.mark.parametrize("name,kind,pattern", [("patient_name", "phi", "name"), ("mac_address", "phi", "address"), ("Date-of-Birth", "phi", "birth"), ("pt_age", "phi", "pt_"), ("age_pt", "phi", "_pt"), ("site_code", "recode", "site"), ("case.number", "warning", "number"), ("filename", "safe", None), ("dose_mg", "safe", None), ("courriel", "phi", "courriel"), ("nome_mae", "phi", "nome")])
def test_column_names(name, kind, pattern):
    got = columns.check_name(name)
    assert (got.classification, got.pattern) == (kind, pattern)
    assert (got.warning is None) == (kind == "safe")


def test_p2():
    assert abs(p2_quantile(range(1, 101)) - 50.5) <= 2 and abs(p2_quantile(range(1, 101), 0.25) - 25) <= 5
    assert (p2_quantile([]), p2_quantile([3]), p2_quantile([1, 2]), p2_quantile([1, 2, 3]), p2_quantile([4, 3, 2, 1])) == (None, 3, 2, 2, 3)
    rng = random.Random(0)
    x = [rng.gauss(5, 2) for _ in range(20000)]
    assert abs(p2_quantile(x) - statistics.median(x)) < 0.1


def walk(values, sample):
    """Types in the order of rows, one value at a time."""
    kinds = {"boolean": lambda v: v.lower() in s.TRUE + s.FALSE, "integer": lambda v: v.lstrip("+-").isdigit(), "numeric": lambda v: v.replace(".", "", 1).lstrip("+-").isdigit(), "datetime": lambda v: len(v) == 19 and v[10] == " ", "date": lambda v: len(v) == 10 and v[4] == "-"}
    filled = [v for v in values if v is not None]
    now = infer.initial({k: all(map(f, filled[:sample])) for k, f in kinds.items()}) if filled else "string"
    longs = 0
    for v in filled[sample:]:
        if len(v) > s.LONG_BYTES:
            longs += 1
            if longs >= infer.FREE_TEXT_LEAST and now == "string":
                now = "free_text"
        if now == "integer" and not kinds["integer"](v):
            now = "numeric" if kinds["numeric"](v) else "string"
        elif now == "numeric" and not kinds["numeric"](v) or now == "boolean" and not kinds["boolean"](v):
            now = "string"
        elif now in ("date", "datetime") and not kinds["date"](v):
            now = "datetime" if kinds["datetime"](v) else "string"
    return now


def test_inference_is_row_by_row(spark):
    rng = random.Random(9)
    pool = {"b": ["true", "0", "1", "no"], "i": ["1", "0", "77"], "n": ["1", "2.5"], "d": ["2024-01-15"], "t": ["2024-01-15 10:00:00"], "s": ["x"], "l": ["y" * 120]}
    cols = []
    for _ in range(40):
        a, b, c = (rng.choice(list(pool)) for _ in range(3))
        n = rng.choice((3, 6, 12, 30))
        col = [rng.choice(pool[a]) for _ in range(n)] + [rng.choice(pool[b]) for _ in range(rng.randrange(20))] + [rng.choice(pool[c]) for _ in range(rng.randrange(20))]
        for _ in range(4):
            col.insert(rng.randrange(len(col)), None)
        cols.append((col + [None] * 90)[:90])
    rows = [(i, *(c[i] for c in cols)) for i in range(90)]
    df = spark.createDataFrame(rows, "r long, " + ", ".join(f"x{i} string" for i in range(40))).repartition(4)
    got = profile(df, Options(sample=8, median="none"), order_by="r", columns=[f"x{i}" for i in range(40)])
    assert [c.dtype for c in got.columns] == [walk(c, 8) for c in cols]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def column(doc, i):
    return doc["sheets"][0]["columns"][i]


def test_csv(spark, tmp_path):
    body = '﻿int,num,site_code,patient_name,note,int\n1,1.5,VAN-001,John Doe,"a ""q"", b\nc",1\n\nNA,2.5,CAL-002,Jane Smith,,2\n2,x,VAN-001,Al\n,3,NA,Bo,z,3,extra\n'
    path = write(tmp_path / "t.csv", body)
    got = scan(spark, path, Options(bucket_counts=False, k=1))
    doc, table = got.manifest, got.tables[0]
    assert (doc["format"], doc["file_hash"]) == ("csv", hashlib.sha256(body.encode()).hexdigest())
    assert [c["dtype"] for c in doc["sheets"][0]["columns"]] == ["integer", "string", "string", "string", "string", "integer"]
    assert [c.missing for c in table.columns] == [2, 0, 1, 0, 1, 0]  # absent fields are not missing
    assert column(doc, 3)["name"]["type"] == "Suppressed" and "unique_values" not in column(doc, 3)
    assert column(doc, 2)["classification"] == "recode" and [v["value"] for v in column(doc, 2)["unique_values"]] == ["Site_A", "Site_B"]
    assert "## Column 3: site_code" in got.recode_key and "Site_A = VAN-001" in got.recode_key
    assert {v["value"] for v in column(doc, 4)["unique_values"]} == {'a "q", b\nc', "z"}
    assert any("Column 4" in w for w in doc["warnings"]) and len(mf.all_warnings(doc)) > len(doc["warnings"])
    assert column(doc, 0)["stats"]["count"]["value"] == 2 and column(doc, 0)["stats"]["median"] == 2
    assert json.loads(mf.to_json(doc)) == doc
    assert as_frame(spark, table).count() == 6


def test_tsv_empty_and_errors(spark, tmp_path):
    got = scan(spark, write(tmp_path / "t.tab", "a\tb\n1\tx,y\n"), Options(hash_file=False))
    assert got.manifest["format"] == "tsv" and got.recode_key is None and "file_hash" not in got.manifest
    assert scan(spark, write(tmp_path / "h.csv", "a,b\n")).manifest["sheets"][0]["row_count"]["value"] == "0"
    assert scan(spark, write(tmp_path / "e.csv", "")).manifest["sheets"][0]["columns"] == []
    for bad in ("x.xyz", "x", "x.dta"):
        with pytest.raises(UnsupportedFormatError):
            format_of(bad)
    for bad in ("b.xls", "b.xlsb", "b.xlsx"):
        with pytest.raises(InvalidInputError):
            scan(spark, write(tmp_path / bad, "?"))
    assert sha256_of(write(tmp_path / "c", "test content")) == hashlib.sha256(b"test content").hexdigest()


def test_text_of_any_path(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"part{k}.csv", f"id,note\n{k},\"a\n{k}\"\n")
    path = f"file://{tmp_path}/part*.csv"
    got = scan(spark, path, Options(bucket_counts=False))
    assert got.tables[0].rows == 3 and "file_hash" not in got.manifest
    one = scan(spark, f"file://{tmp_path}/part1.csv")
    assert one.manifest["file_hash"] == sha256_of(tmp_path / "part1.csv") == sha256_of(f"file://{tmp_path}/part1.csv", spark=spark)
    (tmp_path / "bad.csv").write_bytes(b"a,b\n" + b"1,x\n" * 9000 + b"2,\xff\xfe\n")
    for f in (scan, spec.spec_scan):
        with pytest.raises(InvalidInputError, match="UTF-8"):
            f(spark, str(tmp_path / "bad.csv"))
    write(tmp_path / "good.csv", "a,b\n1,\ufffd\n")  # the character itself is no error
    assert scan(spark, str(tmp_path / "good.csv")).tables[0].rows == 1


def test_no_column_name_is_reserved(spark):
    df = spark.createDataFrame([(i, f"v{i % 2}", "x") for i in range(20)], "row long, value string, `__row` string")
    assert [(c.header, c.dtype) for c in profile(df, Options(median="p2")).columns] == [("row", "integer"), ("value", "string"), ("__row", "string")]
    labels = spark.createDataFrame([("v0", "Site_A")], "value string, label string")
    got = recode.apply(df.withColumnRenamed("__row", "label"), "value", labels)
    assert got.columns == ["row", "value", "label"] and {r["value"] for r in got.collect()} == {"Site_A", "v1"} and got.count() == 20


def test_values_in_the_shape_of_a_name_are_withheld(spark):
    df = spark.createDataFrame([(v,) for v in ["Kim Novak"] * 30 + ["Arm B"] * 30 + ["low dose"] * 30 + ["João Silva"] * 30], "who string")
    assert profile(df).columns[0].values == ["Arm B", "low dose"]
    lists = phi.NameLists.of(["novak"], ["ana"])
    assert not lists.by_shape and profile(df, names=lists).columns[0].values == ["Arm B", "João Silva", "low dose"]
    names = phi.NameLists.of()
    for v in ("Kim Novak", "Ana M. Prado", "Zoé O'Neil-Berg", "Anna Lena Maier"):
        assert names.likely(v), v
    for v in ("Not applicable", "TYPE One", "Week 12", "A B", "one two", "Ab Cd Ef Gh"):
        assert not names.likely(v), v


def test_p2_by_column_streams_rows_in_order(spark):
    rng = random.Random(3)
    rows = [(k, i, None if i % 7 == 0 else rng.random() * (k + 1)) for k in range(5) for i in range(400 * k + 3)]
    df = spark.createDataFrame(rows, "col_idx int, row_idx long, num double").repartition(4)
    got = {r["col_idx"]: r["p2"] for r in p2_by_column(df).collect()}
    assert got == {k: p2_quantile(x for c, _, x in sorted(rows, key=lambda r: r[:2]) if c == k and x is not None) for k in range(5)}


def test_specification_of_an_empty_file_and_its_medians(spark, tmp_path):
    doc = spec.spec_scan(spark, write(tmp_path / "none.csv", ""))
    assert doc["sheets"] == [{"sheet_name": "none.csv", "sheet_index": 0, "total_rows": "0", "total_columns": 0, "columns": []}]
    values = [random.Random(k).random() * 100 for k in range(300)]
    path = write(tmp_path / "x.csv", "x\n" + "\n".join(map(str, values)) + "\n")
    for options, median, method in ((spec.spec_options(), p2_quantile(values), "p2_approx"), (spec.spec_options(relaxed=True), statistics.median(values), "exact")):
        doc = spec.spec_scan(spark, path, options)
        said = doc["sheets"][0]["columns"][0]["stats"]
        assert said["median"] == pytest.approx(median) and said["median_method"] == doc["privacy"]["median_method"] == method


def test_command_line(spark, tmp_path, capsys):
    path = write(tmp_path / "t.csv", "site,arm\n" + "\n".join(f"S{i % 3},{'ab'[i % 2]}" for i in range(30)) + "\n")
    assert cli.main(["scan", "-i", path, "--surnames", path]) == 2 and "together" in capsys.readouterr().err
    assert cli.main(["scan", "-i", path, "--spec"]) == 0
    assert json.loads(capsys.readouterr().out)["privacy"]["k"] == 20
    assert cli.main(["scan", "-i", path, "-o", str(tmp_path / "out.json"), "--no-recode-key"]) == 0 and not (tmp_path / "t.recode.txt").exists()
    assert json.loads((tmp_path / "out.json").read_text())["options"]["k_anonymity"] == 5
    assert cli.main(["scan", "-i", path]) == 0 and "Site_A = S0" in (tmp_path / "t.recode.txt").read_text()
    assert cli.main(["scan", "-i", "x.dta"]) == 1


def workbook(path):
    cells = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>day</t></is></c><c r="D2" t="str"><v>flag</v></c></row><row r="3"><c r="B3"><v>1</v></c><c r="C3" s="1"><v>44927.7</v></c><c r="D3" t="b"><v>1</v></c></row><row r="5"><c r="B5"><v>2.5</v></c><c r="D5" t="e"><v>#N/A</v></c></row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="a"/><sheet name="None" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", "<worksheet><sheetData/></worksheet>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><r><t>do</t></r><r><t>se</t></r></si></sst>")
        z.writestr("xl/styles.xml", '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
    return str(path)


def test_workbook(spark, tmp_path):
    path = workbook(tmp_path / "w.xlsx")
    assert Workbook(path).shape(0) == (["dose", "day", "flag"], 1) and column_index("AA10") == 26
    assert serial_to_date(44927) == "2023-01-01" and serial_to_date(1e12) == "1000000000000"
    got = scan(spark, path, Options(bucket_counts=False))
    one, none = got.manifest["sheets"]
    assert [c["dtype"] for c in one["columns"]] == ["numeric", "date", "boolean"] and one["row_count"]["value"] == 3
    assert [(c.count, c.missing) for c in got.tables[0].columns] == [(2, 1), (1, 2), (0, 2)]
    assert none == {"name": "None", "index": 1, "row_count": {"type": "Integer", "value": 0}, "columns": []}


def test_cap_and_high_cardinality(spark):
    df = spark.range(2001).select(F.col("id").alias("age"), (F.col("id") % 2000).alias("score"), F.col("id").cast("string").alias("patient"), F.lit("x").alias("arm"), F.array(F.col("id") % 2).alias("nested"))
    got = profile(df, Options(median="exact"))
    assert [c.n_distinct for c in got.columns] == [None, 2000, None, 1, 2]
    assert [c.classification for c in got.columns] == ["high_cardinality", "safe", "phi", "safe", "safe"]
    assert got.columns[0].median == 1000 and got.columns[2].min is None and got.columns[3].values == ["x"]
    doc = scan_frame(df).manifest
    assert column(doc, 0)["stats"]["unique_count"]["type"] == "Suppressed"


def test_profile_does_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a, b = (profile(x, Options(median="approx"), order_by="o_orderkey") for x in (df.coalesce(1), df.repartition(7)))
    for x, y in zip(a.columns, b.columns, strict=True):
        assert (x.dtype, x.n_distinct, x.values, x.min, x.max) == (y.dtype, y.n_distinct, y.values, y.min, y.max)
        assert x.mean == pytest.approx(y.mean) if x.mean is not None else y.mean is None


def test_spec_document(spark, tmp_path):
    rows = "\n".join(f"{i % 2},{i * 1.5},{'M' if i % 3 else 'F'},2024-01-{i % 28 + 1:02d},AB{i % 4},Smith" for i in range(60))
    path = write(tmp_path / "s.csv", f"arm,dose,sex,seen,batch,operator_name\n{rows}\n")
    doc = spec.spec_scan(spark, path, spec.spec_options())
    cols = {c["name"]: c for c in doc["sheets"][0]["columns"]}
    assert cols["sex"]["values"] == [{"value": "F", "count": "11-20"}, {"value": "M", "count": "21-100"}] or not cols["sex"]["exported_values"]
    assert cols["dose"]["classification"] == "continuous" and cols["dose"]["stats"]["max"] == 88.5
    assert cols["seen"]["range"] == {"min": "2024-01-01", "max": "2024-01-28"}
    assert not cols["batch"]["exported_values"] and not cols["operator_name"]["exported_values"] and "operator_name" in doc["phi_risk_columns"]
    small = spec.spec_scan(spark, write(tmp_path / "few.csv", "x\n" + "\n".join(map(str, range(12))) + "\n"), spec.spec_options())
    assert small["sheets"][0]["columns"][0]["stats_suppressed"] is True
    assert spec.write_spec(doc, path).name == "s_schema.json"
    assert date.fromisoformat(cols["seen"]["range"]["min"])


def test_schema_checker():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"enum": ["x"]}}, "$defs": {"n": {"oneOf": [{"type": "integer", "minimum": 0}, {"type": "string", "pattern": "^z"}]}}, "if": {"properties": {"a": {"const": 1}}}, "then": {"required": ["b"]}}
    assert problems({"a": 2}, schema) == [] and problems({"a": "zz"}, schema) == []
    assert all(problems(x, schema) for x in ({}, {"a": -1}, {"a": "y"}, {"a": 1}, {"a": 2, "c": 0}, {"a": 2, "b": "q"}, 5))


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT bucket_count(7) a, is_missing_token(' N/A ') b, phi_pattern('x@y.org') c, index_to_label(26) d, is_integer_text('9223372036854775808') e, is_numeric_text('.5') f, is_datetime_text('2024-01-01T00:00:00Z') g").first()
    assert tuple(row) == ("6-10", True, "email", "AA", False, True, True)


def test_stream(spark, tmp_path):
    schema = "ts timestamp, x double, label string"
    for k in range(3):
        spark.sql(f"SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 20) ts, double(id + {k}) x, IF(id % 5 = 0, 'NA', 'b') label FROM range(10)").write.parquet(f"{tmp_path}/in/{k}")
    run = RunningProfile()
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(90)
    x = [i + k for k in range(3) for i in range(10)]
    m = run.columns["x"]
    assert (m.rows, m.n, m.low, m.high) == (30, 30, 0, 11) and m.std_dev == pytest.approx(statistics.stdev(x)) and run.columns["label"].missing == 6
    run(spark.range(3).toDF("x"), 0)  # a batch that comes again
    assert run.columns["x"].n == 30 and Moments().merge(Moments()).n == 0
    # a row each 20 minutes, NA in the first and second hour
    assert windowed_counts(spark.read.parquet(f"{tmp_path}/in/0"), by="label").count() == 6
