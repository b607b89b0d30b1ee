"""WARC, SimHash, URL filter, mixing, language ID, sharding: brute force and edge cases."""

import datetime
import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import hosts, langid, mixing, sharding, simhash, warc


class Bytes:
    def __init__(self, data):
        self.file = io.BytesIO(data)

    def read_at(self, n, at):
        self.file.seek(at)
        return self.file.read(n)


def test_every_split_owns_each_record_once():
    rng = random.Random(1)
    nested = warc.record(999, None, b"inner" * 30, "d")
    payloads = [b"", b"<p>\xc3\xa9</p>" * 50, nested, bytes(rng.randrange(256) for _ in range(3000)), b"\x1f\x8b\x08" * 40]
    data, starts = b"", []
    for i in range(40):
        starts.append(len(data))
        p = payloads[i % len(payloads)]
        data += warc.record(i, f"http://x.org/{i}", p, hashlib.sha256(p).hexdigest(), 3 if i % 7 == 6 else None)
    for split in (1, 97, 1000, 10**6):
        got = [(o, h["warc-record-id"]) for a in range(0, len(data), split) for o, h, _ in warc.records(Bytes(data), len(data), a, min(a + split, len(data)), step=64)]
        assert got == [(s, f"<urn:page:{i}>") for i, s in enumerate(starts)], split


def test_warc_round_trip(spark):
    long = "x" * 120
    rows = [(5, "http://a.org/ b\n", long), (3, None, long), (9, "http://c.org", long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "http://é.org", "é" * 60), (8, "u", "é" * 60), (None, "u", long), (3, "u", "other" * 30), (10, "u", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, split_bytes=300).collect())
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        again = len(data) >= 100 and (page is None or page > min(ids))
        want[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_ids_that_could_break_a_header(spark, tmp_path):
    rows = [("", "u", "a" * 120), ("x\r\nEvil: 1", "u", "a" * 120), ("é %41 b", "u", "b"), (None, "u", "a" * 120), ("z", "u\r\nEvil: 2", "c")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {"": ("response", None), "x\r\nEvil: 1": ("revisit", ""), "é %41 b": ("response", None), None: ("revisit", ""), "z": ("response", None)}


def test_damaged_members_are_told(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 300) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    files = warc.write(pages, str(tmp_path))
    (name, size), = [(r["path"], r["size"]) for r in files.collect()]
    whole = warc.read(spark, str(tmp_path), files, 500)
    assert whole.count() == 40 and warc.gaps(whole, files).count() == 0
    at, length = whole.where("page_id = 7").select("offset", "length").first()
    last = whole.orderBy(F.desc("offset")).first()
    data = bytearray(open(name, "rb").read())
    data[at + length - 8] ^= 255  # its checksum
    open(name, "wb").write(bytes(data[:-5]))  # and the last member is cut off
    files = spark.createDataFrame([(name, size - 5)], "path string, size long")
    left = warc.read(spark, str(tmp_path), files, 500)
    lost = sorted((r["start"], r["bytes"]) for r in warc.gaps(left, files).collect())
    assert left.count() == 38 and lost == sorted([(at, length), (last["offset"], last["length"] - 5)])


def test_member_with_bad_checksum_is_no_record():
    good = warc.record(1, "u", b"a" * 500, "d")
    bad = good[:-6] + b"\0\0" + good[-4:]
    data = bad + good
    assert [o for o, _, _ in warc.records(Bytes(data), len(data), 0, len(data))] == [len(bad)]
    with pytest.raises(zlib.error):
        zlib.decompress(bad, 31)


def brute_simhash(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """doc -> smallest linked doc."""
    docs = sorted(prints)
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(docs):
        for b in docs[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


@pytest.mark.parametrize("most", [48, 3])
def test_simhash_is_brute_force(spark, most):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klm") for _ in range(n))
    docs = {0: None, 1: "", 2: " \n", 3: "one", 4: "ONE", 5: "one two", 6: "é\x0bÉ x"}
    for i in range(7, 40):
        docs[i] = text(rng.randrange(1, 300))
    for i in range(40, 160):  # near copies, chains of them
        w = docs[rng.randrange(30, i)].split()
        w[rng.randrange(len(w))] = "zz"
        docs[i] = " ".join(w)
    df = spark.createDataFrame([(i, t, "f") for i, t in docs.items()], "doc_id long, text string, fingerprint string").repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.groups(df, most_in_cell=most).collect()}
    prints = {i: brute_simhash(t) for i, t in docs.items()}
    want = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in docs}
    if most == 48:
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({*want.values()})


@pytest.mark.parametrize("most", [48, 4, 1])
def test_links_of_crowded_fingerprints_keep_components(spark, most):
    rng = random.Random(7)
    prints = {rng.getrandbits(64)}
    while len(prints) < 250:
        x = rng.choice(sorted(prints))
        for _ in range(rng.choice((1, 1, 2, 3))):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {0, 1, 3, (1 << 64) - 1}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    edges = simhash.links(df, most_in_cell=most)
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints}
    want = brute_components({s: x for x, s in signed.items()})
    assert {s: roots.get(s, s) for s in signed.values()} == want


def test_keep_one_of_rows_that_share_an_id(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "completely other words here now"), (2, "alpha beta gamma delta"), (3, "alpha beta gamma delta"), (3, "alpha beta gamma delta")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == rows[:2]


@pytest.mark.parametrize("many", [1, 1000])
def test_a_hot_fingerprint_is_joined_by_broadcast(spark, many, monkeypatch):
    monkeypatch.setattr(simhash, "MANY", many)
    rows = [(i, "boilerplate of half the rows") for i in range(100)] + [(200 + i, f"{i} own words {i * 7} here {i * i}") for i in range(100)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components({i: brute_simhash(t) for i, t in rows})


def test_components_with_a_hub_that_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW_EDGES", 0)
    monkeypatch.setattr(simhash, "MOST_HUBS", 20)
    edges = [(1000, i) for i in range(2000, 2300)] + [(i, i + 1) for i in range(5, 40)] + [(40, 2100), (3000, 3001)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 5 for i in range(6, 41)}, 1000: 5, **{i: 5 for i in range(2000, 2300)}, 3001: 3000}


def test_simhash_of_odd_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "only null ids have this text"), (2, "quite another text, of more words")]
    df = spark.createDataFrame(rows, schema)
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.groups(df).collect())
    assert got == Counter({(1, 1): 2, (None, 1): 1, (None, None): 1, (2, 2): 1})
    assert sorted((r["doc_id"] or 0) for r in simhash.keep_one(df).collect()) == [0, 0, 1, 2]


def test_url_rules_and_reputation(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.Example.ORG/en/15?x", "http://example.org/es/", "http://example.org/en/2#a", "http://org/", "http://org", "http://x.com/fr/", "http://com/de/1", "http://xcom/fr/", "http://a.net/b?c/d", "x://É.net#/", "http://bad.net/1", "http://good.net/1", "http://a.b.co.uk/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(100 + i, "http://bad.net/2", "h") for i in range(60)] + [(200 + i, "http://good.net/2", "h") for i in range(60)], "page_id long, url string, host string").drop("host")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(60)] + [(200 + i, 1, 0) for i in range(59)] + [(259, None, 1), (16, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in hosts.judge(pages, labels).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for v, r in hosts.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (max(fits)[1] if fits else None)
        if fits:
            assert got[i]["verdict"] == max(fits)[2]
    assert got[14]["verdict"] == "block" and got[15]["verdict"] == "allow" and got[16]["verdict"] == "allow"
    none = hosts.judge(pages, labels.limit(0))
    assert {r["verdict"] for r in none.where("rule is null").collect()} == {"allow"}
    assert hosts.judge(pages.limit(0), labels).count() == 0


def test_registered_domains(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.com:8080": ("example.com", "com"), "a.example.com.": ("example.com", "com"), "192.168.1.7": ("192.168.1.7", ""), "192.168.1.7:80": ("192.168.1.7", ""), "[2001:db8::1]:443": ("[2001:db8::1]", ""), "me@www.site.org": ("site.org", "org"), "localhost": ("localhost", ""), "": ("", ""), "www.blog.city.jp": ("city.jp", "jp"), "a.kids.us": ("kids.us", "us")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    got = {r["host"]: (r["d"], r["s"]) for r in df.select("host", *(c.alias(n) for c, n in zip(hosts.domain_of(F.col("host")), "ds", strict=True))).collect()}
    assert got == want
    domain, suffix = hosts.domain_of(F.col("host"), ("kids.us",))
    assert df.where("host = 'a.kids.us'").select(domain, suffix).first()[:] == ("a.kids.us", "kids.us")


def test_a_host_with_half_the_pages_gets_the_same_verdicts(spark, monkeypatch):
    urls = ["http://hot.net/x"] * 60 + [f"http://h{i}.org{i % 3}/x" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    want = sorted(map(repr, hosts.judge(pages, labels).collect()))
    monkeypatch.setattr(hosts, "MOST_HOSTS", 5)
    assert sorted(map(repr, hosts.judge(pages, labels).collect())) == want


def brute_reputation(rows):
    """The lower bound of each host's bad rate of (host, bad) by the formulas written out, one level after another."""
    n, bad = Counter(), Counter()
    for h, b in rows:
        n[h] += b is not None
        bad[h] += b or 0
    parts = {h: h.split(".") for h in n}
    domain = {h: ".".join(p[-2:]) if len(p) > 1 else h for h, p in parts.items()}
    suffix = {h: p[-1] if len(p) > 1 else "" for h, p in parts.items()}

    def up(names):
        a, b = Counter(), Counter()
        for h in n:
            a[names(h)] += n[h]
            b[names(h)] += bad[h]
        return a, b

    def shrunk(n, bad, prior):
        own = [k for k in n if n[k]]
        extra = sum((n[k] - 1) * prior[k] * (1 - prior[k]) for k in own)
        spread = sum(n[k] * (bad[k] / n[k] - prior[k]) ** 2 for k in own) - sum(prior[k] * (1 - prior[k]) for k in own)
        strength = 1 / min(max(spread / extra if extra else 0.0, 0.001), 0.999) - 1
        return {k: ((bad[k] + strength * prior[k]) / (n[k] + strength), n[k] + strength) for k in n}

    overall = (sum(bad.values()) + 0.5) / (sum(n.values()) + 1)
    sn, sb = up(lambda h: suffix[h])
    s = shrunk(sn, sb, dict.fromkeys(sn, overall))
    dn, db = up(lambda h: (domain[h], suffix[h]))
    d = shrunk(dn, db, {k: s[k[1]][0] for k in dn})
    out = shrunk(n, bad, {h: d[domain[h], suffix[h]][0] for h in n})
    return {h: (r, r - hosts.Z * math.sqrt(r * (1 - r) / (w + 1))) for h, (r, w) in out.items()}


def test_reputation_is_the_formula(spark):
    rng = random.Random(9)
    names = [f"{a}.{b}.{c}" for a in ("www", "m", "x") for b in ("one", "two", "bad") for c in ("com", "net")] + ["plain", ""]
    rows = [(h, rng.choice([None, 0, 1 if "bad" in h else rng.choice((0, 0, 1))])) for h in (rng.choice(names) for _ in range(900))]
    got = {r["host"]: (r["rate"], r["bound"]) for r in hosts.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    want = brute_reputation(rows)
    assert got.keys() == want.keys()
    for h, pair in want.items():
        assert got[h] == pytest.approx(pair, rel=1e-9)


def brute_mix(rows, alpha=0.5, seed=mixing.SEED):
    n = Counter(s for _, s in rows)
    w = {s: c**alpha for s, c in n.items()}
    out = Counter()
    for doc, s in rows:
        rate = w[s] / sum(w.values()) * len(rows) / n[s]
        u = int(hashlib.md5(f"{seed}:1:{doc}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out[doc] = k
    return out


def test_mixing_is_brute_force(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 4}") for i in range(3000)] + [(5000 + i, None) for i in range(20)]
    df = spark.createDataFrame([(i, f"t{i}", s, "c") for i, s in rows], "doc_id long, text string, source string, copy string")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "copy", "copy_", "mix_key"]
    got = out.collect()
    want = brute_mix(rows)
    assert Counter(r["doc_id"] for r in got) == Counter({d: k for d, k in want.items() if k})
    keys = [r["mix_key"] for r in got]
    assert keys == sorted(keys)  # the order of partitions, too
    assert mixing.mix(df, keep_keys=False).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_keeps_columns_of_any_name(spark, monkeypatch):
    names = ["mix_source", "mix_source_n", "mix_source_parts", "mix_source_at_most", "row", "ident", "by", "times", "key", "a.b", "__key"]
    rows = [(i, "t", f"s{i % 9}", *(100 * i + k for k in range(len(names)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    plain = sorted(map(tuple, mixing.mix(df, keep_keys=False).collect()))
    assert mixing.mix(df, keep_keys=False).columns == df.columns and set(plain) <= set(rows) and len(plain) > 200
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)  # sources beyond it are joined by a shuffle
    assert sorted(map(tuple, mixing.mix(df, keep_keys=False).collect())) == plain


def test_mixing_weights_and_large_rates(spark):
    df = spark.createDataFrame([(1, None, "rare"), (None, "no id", "rare"), (2, "", "common"), (3, "", "none")], "doc_id long, text string, source string")
    got = Counter(r["source"] for r in mixing.mix(df, weights={"rare": 3, "common": 1}, total=8000).collect())
    assert set(got) == {"rare", "common"}
    assert abs(got["rare"] - 6000) < 400 and abs(got["common"] - 2000) < 250


def letters(text):
    return any(c.isalpha() for c in text or "")


def test_language_scores_are_those_of_naive_bayes(spark):
    """numpy's batches against the sums written out, and texts don't see their neighbours."""
    table = langid._letters()
    texts = ["abc ab", "Ábc 12 x", "", "...", "𝄞𐐀", "zz top"]
    many = [t.encode() for t in texts]
    buckets, starts, has = langid.features(many, table)
    for k, t in enumerate(many):
        alone, _, h = langid.features([t], table)
        end = starts[k + 1] if k + 1 < len(many) else buckets.shape[1]
        assert (buckets[:, starts[k] : end] == alone).all() and h[0] == has[k] == letters(texts[k])
    counts = {x: np.random.default_rng(i).integers(0, 9, langid.BUCKETS).astype(float) for i, x in enumerate("ab")}
    model = langid.Model(counts, {"a": 3, "b": 1})
    langs, sure = model.predict(many, table)
    for t, lang, s in zip(many, langs, sure, strict=True):
        b = langid.features([t], table)[0].ravel()
        raw = {x: math.log({"a": 0.75, "b": 0.25}[x]) + sum(math.log((counts[x][i] + 0.5) / (counts[x].sum() + 0.5 * langid.BUCKETS)) for i in b[b < langid.BUCKETS]) for x in "ab"}
        top = max(raw, key=raw.get)
        if letters(t.decode()):
            assert lang == top and s == pytest.approx(1 / sum(math.exp(v - raw[top]) for v in raw.values()))
        else:
            assert (lang, s) == ("und", 0.0)


def test_language_model_is_counted_from_the_usable_documents(spark, monkeypatch):
    texts = ["the cat", "Le chat!", "", "das 7", "the dog", "le chien", None, "...", "not used", "no id"]
    langs = ["en", "fr", "en", "de", "en", "fr", "en", "xx", None, "en"]
    rows = [(None if t == "no id" else i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))] + [(i, f"text {i}", "en") for i in range(20, 60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    counts, docs, table = {}, Counter(), langid._letters()
    for i, t, x in rows:
        if i is not None and x and zlib.crc32(str(i).encode()) % 4 != 2:
            b = langid.features([(t or "").encode()], table)[0].ravel()
            counts[x] = counts.get(x, 0) + np.bincount(b[b < langid.BUCKETS], minlength=langid.BUCKETS)
            if letters(t):  # other texts add the gap that they are, but no document
                docs[x] += 1
    want = langid.Model(counts, docs)
    assert model.languages == want.languages and np.allclose(model.log, want.log) and np.allclose(model.prior, want.prior)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", None, 0), (90002, " 123 ", None, "s", 5), (None, "the of and", None, None, 1)], docs.schema)
    got = langid.predict(docs.unionByName(odd), langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert len(held) > 150 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (90001, 90002)} == {90001: "und", 90002: "und"}
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(docs.limit(5), none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), none).count() == 0


def brute_shards(docs, shards=8):
    groups = defaultdict(list)
    for doc, t in docs:
        groups[t or ""].append(doc)
    order = sorted(groups, key=lambda t: min(groups[t]))
    sizes = [len(groups[t]) * (len(t.encode()) + 1) for t in order]

    def fill(c):
        out, have, k = [], 0, 0
        for s in sizes:
            if s > c:
                return None
            if have + s > c:
                have, k = 0, k + 1
            have += s
            out.append(k)
        return out if k < shards else None

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fill(mid) else (mid + 1, high)
    placed, slots = {}, Counter()
    for t, k in zip(order, fill(low), strict=True):
        for d in sorted(groups[t]):
            placed[d] = (k, slots[k])
            slots[k] += 1
    return placed


@pytest.mark.parametrize("hot", [0, 400])
def test_sharding_is_brute_force(spark, hot, monkeypatch):
    rng = random.Random(8)
    docs = [(i * 2, "é" * rng.randrange(200) + str(rng.randrange(300))) for i in range(700)] + [(3001, None), (3003, ""), (3005, "x" * 3000)]
    docs += [(5001 + 2 * i, "hot") for i in range(hot)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, shard string").repartition(4)
    monkeypatch.setattr(sharding, "LISTED", 16)
    monkeypatch.setattr(sharding.minimax_cuts, "__defaults__", (16,))  # many rounds of refining
    got = sharding.assign(df).collect()
    want = brute_shards(docs)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want
    texts = dict(docs)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)


def test_sharding_of_few_and_odd_rows(spark):
    schema = "doc_id long, text string"
    assert sharding.assign(spark.createDataFrame([], schema)).count() == 0
    got = sharding.assign(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None)], schema)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == 5 and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(by) < 8


@pytest.mark.parametrize("kind", ["string", "date", "nulls", "one id"])
def test_sharding_takes_any_id(spark, kind):
    rng = random.Random(9)
    make = {"string": lambda i: f"doc-{i:05d}-é", "date": lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i), "nulls": lambda i: None, "one id": lambda i: 7 if i % 3 else i}[kind]
    docs = [(make(i), f"{'x' * rng.randrange(50)} {rng.randrange(200)}") for i in range(600)]
    df = spark.createDataFrame(docs, f"doc_id {({'string': 'string', 'date': 'date'}).get(kind, 'long')}, text string").repartition(4)
    got = sharding.assign(df).collect()
    if kind in ("string", "date"):
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == brute_shards(docs)
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == Counter((d, zlib.crc32(t.encode())) for d, t in docs)
    by, of = defaultdict(list), defaultdict(set)
    for r in got:
        by[r["shard"]].append(r["slot"])
        of[r["text_crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(len(v) == 1 for v in of.values()) and len(by) == 8


def test_sharding_in_a_seeded_order(spark):
    docs = [(i, f"text {i % 500}") for i in range(900)]
    got = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), order_seed=3).collect()
    firsts = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert len(got) == 900 and firsts != sorted(firsts) and len({(r["text_crc32"], r["shard"]) for r in got}) == 500
