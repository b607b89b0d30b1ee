"""Secret scan (DataFrame operations only).

Three kinds of secrets are found by pattern. Beyond them, candidate strings (long
runs of key characters) are slid over by a window whose Shannon entropy comes
from counts updated as one character enters and one leaves; a candidate is reported when
its best window reaches the threshold of its character class, unless an
allow-list entry explains it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in order, their patterns, and the least length of what must be long (a group of the pattern).
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: For each character class: what all of a candidate's characters are, and the least bits a character in some window.
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("base64", r"", 3.8))
UNIT = 1_000_000
"""Entropies are compared in millionths, in whole numbers."""

#: The same matches without those that are too short, which lie within runs that no other match can share.
LONG_ONLY = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

_SPAN = "struct<start:int,kind:int,stop:int,match:string>"


def _with(value: Column, use) -> Column:
    """use(value), where value is worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scanned(items: Column, zero: int, step) -> Column:
    """The integer state after each item: step(state, item), from zero on.

    An array that grows is copied with each item. Blocks of about the square root of n
    items bound that by n ** 1.5 small steps in all.
    """
    none = F.array().cast("array<int>")

    def inner(s, x):
        return _with(step(s["last"], x).cast("int"), lambda v: F.struct(v.alias("last"), F.concat(s["out"], F.array(v)).alias("out")))

    def outer(s, block):
        done = F.aggregate(block, F.struct(s["last"].alias("last"), none.alias("out")), inner)
        return _with(done, lambda d: F.struct(d["last"].alias("last"), F.concat(s["out"], F.array(d["out"])).alias("out")))

    def run(x):
        wide = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(x), wide), lambda i: F.slice(x, i, wide))
        start = F.struct(F.lit(zero).alias("last"), F.array().cast("array<array<int>>").alias("out"))
        return F.when(F.size(x) > 0, F.aggregate(blocks, start, outer, lambda s: F.flatten(s["out"]))).otherwise(none)

    return _with(items, run)


def find(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """start, kind, stop (code points), match of leftmost matches that don't overlap; those too short are dropped after matching."""
    all_, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    told = all_ if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def place(each):
        stops = scanned(each, 0, lambda at, x: at + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
        kept = F.filter(F.arrays_zip(each.alias("x"), stops.alias("stop")), lambda y: F.length(y["x"]["told"]) >= least)
        return F.transform(kept, lambda y: F.struct((y["stop"] - F.length(y["x"]["m"])).alias("start"), F.lit(kind).alias("kind"), y["stop"].alias("stop"), y["x"]["m"].alias("match")))

    each = F.arrays_zip(pieces.alias("p"), all_.alias("m"), told.alias("told"))
    return F.when(text.rlike(pattern), _with(each, place)).otherwise(F.array()).cast(f"array<{_SPAN}>")


def apart(seen: Column, base: Column, kind: int, window: int) -> Column:
    """What is left of the spans of seen (all of that kind, which base has none of) without the spans of base, in pieces of window or more.

    One sort, then a pass each way. A piece begins where a span of seen does, or where one of base ends, at
    the end of all of base so far; it ends with the span of seen, or where base goes on.
    """

    def split(every):
        reach = scanned(every, 0, lambda s, e: F.when(e["kind"] == kind, s).otherwise(F.greatest(s, e["stop"])))
        at = scanned(every, 0, lambda s, e: F.when(e["kind"] == kind, s + 1).otherwise(s))
        ahead = F.reverse(scanned(F.reverse(every), 2**31 - 1, lambda s, e: F.when(e["kind"] == kind, s).otherwise(e["start"])))
        # the next span of base after each; a span's own start is not ahead of it
        after = F.concat(F.slice(ahead, 2, F.size(ahead)), F.array(F.lit(2**31 - 1)))

        def piece(y):
            e, c = y["e"], F.get(seen, y["at"] - 1)
            start = F.when(e["kind"] == kind, F.greatest(e["start"], y["reach"])).otherwise(y["reach"])
            stop = F.least(c["stop"], y["after"])
            return _with(F.struct(start.alias("start"), stop.alias("stop"), c.alias("c")), lambda p: F.when(p["c"].isNotNull() & (p["stop"] - p["start"] >= window), F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["stop"].alias("stop"), F.substring(p["c"]["match"], p["start"] - p["c"]["start"] + 1, p["stop"] - p["start"]).alias("match"))))

        return F.filter(F.transform(F.arrays_zip(every.alias("e"), reach.alias("reach"), at.alias("at"), after.alias("after")), piece), lambda x: x.isNotNull())

    return F.when((F.size(seen) == 0) | (F.size(base) == 0), seen).otherwise(_with(F.sort_array(F.concat(base, seen)), split)).cast(f"array<{_SPAN}>")


def _term(n: int) -> int:
    return round(UNIT * n * math.log2(n)) if n else 0


def most_repetition(bits: float, window: int) -> int:
    """The largest sum of n log2 n over the counts of a window with at least so many bits a character."""
    return math.floor(UNIT * window * (math.log2(window) - bits))


def least_sum(string: Column, window: int) -> Column:
    """The smallest sum of n log2 n (millionths) over character counts in any window, by incremental counts.

    Strings are ASCII and as long as the window at least. Each step takes the character that
    leaves (-1 in the first window) and that which enters from arrays, so the work is linear in the length.
    """
    terms = F.lit([_term(n) for n in range(window + 2)])
    term = lambda n: F.element_at(terms, n + 1)
    codes = F.transform(F.split(string, ""), F.ascii)
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("best"))

    def put(counts, code, by):
        return F.concat(F.slice(counts, 1, code), F.array(F.element_at(counts, code + 1) + by), F.slice(counts, code + 2, 127 - code))

    def step(s, x):
        enters, leaves = x["enters"], x["leaves"]
        full = leaves >= 0
        was = F.element_at(s["n"], leaves + 1)
        less = F.when(full, put(s["n"], leaves, -1)).otherwise(s["n"])
        kept = s["sum"] + F.when(full, term(was - 1) - term(was)).otherwise(0)

        def enter(t):
            had = F.element_at(t["n"], enters + 1)
            return F.struct(put(t["n"], enters, 1).alias("n"), (t["sum"] + term(had + 1) - term(had)).cast("bigint").alias("sum"))

        def judge(t):
            best = F.when(x["ends"], F.least(t["sum"], s["best"])).otherwise(s["best"])
            return F.struct(t["n"].alias("n"), t["sum"].alias("sum"), best.cast("bigint").alias("best"))

        return _with(_with(F.struct(less.alias("n"), kept.alias("sum")), enter), judge)

    def steps(c):
        leaving = F.concat(F.array_repeat(F.lit(-1), window), F.slice(c, 1, F.size(c) - window))
        ends = F.concat(F.array_repeat(F.lit(False), window - 1), F.array_repeat(F.lit(True), F.size(c) - (window - 1)))
        return F.aggregate(F.arrays_zip(c.alias("enters"), leaving.alias("leaves"), ends.alias("ends")), start, step, lambda s: s["best"])

    return _with(codes, steps)


def allowed(string: Column) -> Column:
    """Plain words, numbers and what joins them (names, paths), UUIDs, and a single character repeated."""
    plain = F.forall(F.split(string, "[-_/+=]"), lambda p: p.rlike(r"^([A-Za-z]?[a-z]*|[A-Z]+|[0-9]+)$"))
    return plain | string.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$") | string.rlike(r"^(.)\1*$")


def suspicious(string: Column, window: int = WINDOW) -> Column:
    limit = F.lit(most_repetition(CLASSES[-1][2], window))
    for _, only, bits in reversed(CLASSES[:-1]):
        limit = F.when(string.rlike(only), most_repetition(bits, window)).otherwise(limit)
    return F.when(allowed(string), False).otherwise(least_sum(string, window) <= limit)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row; spans are kind:start:end, the fourth kind is entropy.

    Of a candidate that spans of the other kinds meet, what is left is judged, in pieces as long as a window at least. A null text
    counts as empty; repeated rows each get a row; no rows give no rows.
    """
    names = F.lit([*(k for k, *_ in KINDS), "entropy"])
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    last = len(KINDS)
    rows = rows.withColumns({f"k{k}": find(F.col("t"), LONG_ONLY.get(name, pattern), k, group, least) for k, (name, pattern, group, least) in enumerate(KINDS)} | {"seen": find(F.col("t"), CANDIDATE % window, last, 0, window)})
    rows = rows.withColumn("base", F.sort_array(F.concat(*[f"k{k}" for k in range(last)]))).withColumn("apart", apart(F.col("seen"), F.col("base"), last, window))
    base, more = F.col("base"), F.filter("apart", lambda c: suspicious(c["match"], window))
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    counts = [F.size(f"k{k}").cast("long").alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(say(base), 256).alias("base_sha256"), say(F.sort_array(F.concat(base, more))).alias("spans"))
