"""The five stages against their brute-force versions, each on its own input; and the driver's contract."""

import shutil

import pytest
from test_jaccard import brute_kept
from test_record_operators import brute_mix, brute_shards, letters
from test_text_operators import brute_decontam

import corpus_pipeline
from veilframe.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, "123 ...", "en", "src0", 7), (9002, None, None, None, None), (9003, "", "en", "src1", 0)], docs.schema)
    docs.unionByName(odd).coalesce(2).write.parquet(f"{path}/documents.parquet")
    shutil.copy(f"{SF}/benchmark.parquet", path / "benchmark.parquet")
    return str(path)


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = written(stage(spark, docs, folder), f"test-{name}")
        ids = sorted(r["doc_id"] for r in out.collect())
        texts = {r["doc_id"]: r["text"] for r in rows}
        if name != "shard":
            assert out.columns == docs.columns
        if name == "language":
            assert ids == sorted(r["doc_id"] for r in rows if letters(r["text"]))
        elif name == "near_duplicates":
            assert ids == brute_kept([(r["doc_id"], r["text"]) for r in rows])
            assert len(ids) < len(rows)
        elif name == "decontaminate":
            judged = brute_decontam(texts.items(), items)
            assert ids == sorted(i for i in texts if not judged[i][4])
            assert len(ids) < len(rows)
        elif name == "mix":
            want = brute_mix([(r["doc_id"], r["source"]) for r in rows])
            assert ids == sorted(want.elements())
        else:
            got = {}
            for r in out.collect():
                got.setdefault(r["text_crc32"], set()).add(r["shard"])
            assert all(len(v) == 1 for v in got.values()) and len(ids) == len(rows)
            first = {}
            for r in rows:
                first.setdefault(r["doc_id"], r["text"])
            if len(first) == len(rows):
                assert {r["doc_id"]: r["shard"] for r in out.collect()} == {d: s for d, (s, _) in brute_shards(list(first.items())).items()}
        docs = out


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "lang", "source"]
    rows = got.collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), f"again-{name}")
    plain = lambda rs: sorted(map(repr, rs))
    assert plain(rows) == plain(docs.collect())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert rows and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sql_agrees(spark):
    import duckdb

    import __spark_entry__ as entry
    from veilframe.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert set(queries.queries()) <= set(entry.queries())
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        plain = lambda df, cols=cols: sorted(map(repr, ([None if x is None or x != x else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in map(_item, r)] for r in df[cols].itertuples(index=False))))
        assert plain(got.toPandas()) == plain(want), name


def _item(x):
    return x.item() if hasattr(x, "item") else None if x is not None and str(x) == "<NA>" else x


