"""Sharding by minimax contiguous partition (DataFrame operations only).

Equal texts form an atomic group; groups stand in the order of their smallest
id. The smallest shard capacity for which a greedy left-to-right filling needs
no more than the given number of shards is found by binary search, and the
shards are cut there.

Prefix sums are made in ranges of ids and shifted by range totals. The driver
searches over a thinned list of them: cuts at listed sums bound the capacity
from above, cuts anywhere in a thinned gap from below, and only the gaps that
can hold a cut are listed more finely until both bounds meet.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cuts, shuffle_partitions, written

SHARDS = 8
LISTED = 16_384


class Sums:
    """Ascending prefix sums of which some gaps hide more."""

    def __init__(self, listed: list[tuple[int, bool]]):
        self.at = [0, *(s for s, _ in listed)]
        self.hides = [False, *(h for _, h in listed)]  # the gap before each

    def reach(self, start: int, capacity: int, hopeful: bool) -> int:
        """The farthest cut from start: at a listed sum, or if hopeful anywhere in a gap that hides some."""
        i = bisect_right(self.at, start + capacity) - 1
        if hopeful and i + 1 < len(self.at) and self.hides[i + 1]:
            return start + capacity
        return max(self.at[i], start)

    def fill(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """The cuts of a greedy filling."""
        cuts, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, hopeful)
            cuts.append(at)
        return cuts

    def capacity(self, shards: int, hopeful: bool, low: int = 0) -> int:
        """The smallest for which the filling ends at the last sum."""
        low, high = max(low, -(-self.at[-1] // shards)), self.at[-1]
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, hopeful)[-1] >= self.at[-1]:
                high = mid
            else:
                low = mid + 1
        return low

    def open(self, low: int, high: int) -> tuple[int, int] | None:
        """The gaps that hide sums and meet [low, high], as one range (from, to]."""
        i, j = bisect_right(self.at, low), bisect_right(self.at, high)
        found = [k for k in range(max(1, i), min(j + 1, len(self.at))) if self.hides[k]]
        return (self.at[found[0] - 1], self.at[found[-1]]) if found else None

    def refine(self, ranges: list[tuple[int, int]], listed: list[tuple[int, bool]]) -> None:
        inside = lambda s: any(a < s <= b for a, b in ranges)
        kept = [(s, h) for s, h in zip(self.at[1:], self.hides[1:], strict=True) if not inside(s)]
        both = sorted([*kept, *listed])
        self.at, self.hides = [0, *(s for s, _ in both)], [False, *(h for _, h in both)]


def _listed(sums: DataFrame, ranges: list[tuple[int, int]], most: int) -> list[tuple[int, bool]]:
    """The prefix sums of each range (from, to], thinned to about most in all."""
    cell, s = F.lit(None).cast("long"), F.col("cum")
    each, first = max(1, most // len(ranges)), 0
    for a, b in ranges:
        step = -(-(b - a) // each)
        cell = F.when((s > a) & (s <= b), first + F.floor((s - 1 - a) / step)).otherwise(cell)
        first += each + 1
    rows = sums.select(s, cell.alias("cell")).where("cell is not null").groupBy("cell").agg(F.max("cum").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["s"], r["n"] > 1) for r in rows)


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def minimax_cuts(sums: DataFrame, total: int, shards: int, listed: int = LISTED) -> list[int]:
    """Cuts (prefix sums, the last is total) of the greedy filling at the smallest feasible capacity. sums: cum.

    The driver holds about `listed` sums and as many more for each round; twice as many are asked for only after a
    round that did not halve what was open, which takes more shards than the square root of `listed`.
    """
    known, was = Sums(_listed(sums, [(0, total)], listed)), 2 * total

    def finer(ranges: list[tuple[int, int]]) -> None:
        nonlocal listed, was
        wide = sum(b - a for a, b in ranges)
        listed, was = listed if 2 * wide <= was else 2 * listed, wide
        known.refine(ranges, _listed(sums, ranges, listed))

    while True:
        low = known.capacity(shards, True)
        high = known.capacity(shards, False, low)
        if low == high:
            break
        finer(_joined([r for a, b in zip(known.fill(low, shards, False), known.fill(high, shards, True), strict=True) if (r := known.open(a, b))]))
    while True:  # a cut may still stand in a gap, though the capacity is known
        cuts, hoped = known.fill(low, shards, False), known.fill(low, shards, True)
        first = next((k for k in range(shards) if cuts[k] != hoped[k]), None)
        if first is None:
            return cuts
        ranges = _joined([r for k in range(first, shards) if (r := known.open(cuts[k], hoped[k]))])
        if not ranges:
            return cuts
        finer(ranges)


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), order_seed: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns of carry under their names.

    A null text counts as an empty one. Ids may be of any type that can be ordered, null or repeated. Groups of
    equal first ids order by a hash of their text, null ids first; repeated rows share a group and get slots of their own. With
    order_seed groups stand in the order of a seeded hash of their text, not of ids. An empty
    table gives no rows. A group larger than the rest stands alone in its shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    more = {f"carry_{k}": c for k, c in enumerate(carry)}
    # the texts are read once; what follows moves a few dozen bytes for each document
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"), *[F.col(f"`{c}`").alias(k) for k, c in more.items()])
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    first = F.min("doc_id") if order_seed is None else F.xxhash64(F.lit(order_seed), "grp")
    groups = rows.groupBy("grp").agg(first.alias("first_id"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("tie", F.xxhash64("grp"))
    groups = written(groups, "shard-groups")
    cuts = Cuts.of(groups, F.col("first_id"), F.col("tie"), shuffle_partitions(spark))
    groups = groups.withColumn("part", cuts.below(F.col("first_id"), F.col("tie")))
    parts = {r["part"]: (r["b"], r["n"]) for r in groups.groupBy("part").agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")).collect()}
    before_b, before_n, total, count = [], [], 0, 0
    for p in range(len(cuts) + 1):
        before_b.append(total)
        before_n.append(count)
        b, n = parts.get(p, (0, 0))
        total, count = total + b, count + n
    out = [F.col(c) for c in ("doc_id", "size", "text_crc32")]
    tail = [F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col(k).alias(c) for k, c in more.items()]]
    if not total:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).select(*out, *tail)
    w = Window.partitionBy("part").orderBy(F.asc_nulls_first("first_id"), "tie", "grp").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda before: F.element_at(F.lit(before), F.col("part") + 1)
    sums = written(groups.select("grp", "n", (F.sum("bytes").over(w) + at(before_b)).alias("cum"), (F.sum("n").over(w) + at(before_n)).alias("cum_n")), "shard-sums")
    ends = minimax_cuts(sums, total, shards)
    inner = sorted(set(ends[:-1]) - {0, total})
    docs_at = {r["cum"]: r["cum_n"] for r in sums.where(F.col("cum").isin(inner)).select("cum", "cum_n").collect()} if inner else {}
    starts = [0, *(docs_at[c] for c in inner)]
    shard = F.size(F.filter(F.lit(inner), lambda c: c < F.col("cum"))) if inner else F.lit(0)
    placed = sums.withColumn("shard", shard).select("grp", "shard", (F.col("cum_n") - F.col("n") - F.element_at(F.lit(starts), F.col("shard") + 1)).alias("slot0"))
    # a group's rows are numbered range by range of ids, so that no task gets all of a large one
    cuts = Cuts.of(rows, F.col("doc_id"), F.col("row"), shuffle_partitions(spark))
    rows = rows.withColumn("part", cuts.below(F.col("doc_id"), F.col("row")))
    inside = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("here")).withColumn("earlier", F.coalesce(F.sum("here").over(inside), F.lit(0)))
    base = base.join(placed, "grp").select("grp", "part", "shard", (F.col("slot0") + F.col("earlier")).alias("slot0"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("grp", "part").orderBy(F.asc_nulls_first("doc_id"), "row")) - 1)
    return numbered.join(base, ["grp", "part"]).withColumn("slot", F.col("slot0") + F.col("k")).select(*out, *tail)
