"""The near-duplicate stage against brute force over five-word shingles."""

import random

import corpus_pipeline
from veilframe.llm import jaccard


def brute_kept(docs):
    """The ids kept of (id, text): the smallest of each component at Jaccard 0.8 of five-word shingles."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x == sets[j] or both and 5 * both >= 4 * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted(best.values())


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.choice((4, 30, 120, 400)))]
        for _ in range(rng.choice((1, 2, 12))):
            copy = list(text)
            for _ in range(rng.choice((0, 1, 2, len(text) // 40, len(text) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    return [*enumerate([*docs, "", None, " \n"])]


def test_stage_is_brute_force(spark, monkeypatch):
    for seed, often in ((1, 8), (2, 2)):
        monkeypatch.setattr(jaccard, "OFTEN", often)
        docs = near_copies(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = corpus_pipeline.near_duplicates(spark, df, "")
        want = brute_kept(docs)
        assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == want
        assert len(want) < len(docs)


def test_stage_removes_near_copies_of_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_kept([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == want


def test_rows_of_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b), (None, a), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in jaccard.keep_one(df).collect())
    assert got == [(0, ""), (0, a), (1, a), (1, b)]
    assert jaccard.keep_one(df.limit(0)).count() == 0
