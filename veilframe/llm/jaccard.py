"""Near-duplicates by SimHash, told by the exact Jaccard similarity of word shingles.

Fingerprints of five-word shingles are joined by their segment popcounts (simhash), and
what that finds is verified on the shingles themselves. 64 bits can't find all:
at a similarity of four fifths two fingerprints differ in about ten bits, among
which a grid finds nothing. So a set-similarity join completes it. Shingles stand in one order for all texts, those that are
frequent in a sample last. Two sets that share SHARE of their union share a
shingle within the prefixes that the bound leaves, and one from which on enough is left of both, so a join on these finds every
pair. Equal sets are one node before that. Each set has a bitmap of the parity of its
shingles in two to four bits a shingle; two bitmaps never differ in more places than
the sets do, so candidates that differ in too many are dropped. Only for the few that
remain are texts read again and shingles counted.

Components need no more than their connections. Fingerprints link first, and of the texts that share a prefix
shingle a chain by size and a star around the one with the fewest rare shingles, which
is what edited copies have in common. Only what lies in different components of the
verified links is compared after that, by bitmaps within the join, so a large cluster of near copies makes
as many rows as it has members and not their square.

Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import as_bytes, groups_of_rows, share, taken, written
from .simhash import components, kept_rows, print_of, row_hash, shingle_hashes

WORDS = 5
SHARE = (4, 5)
"""The least similarity, as a fraction of whole numbers."""
BATCH_BYTES = 4 << 20
SAMPLE = 20_000
OFTEN = 8
"""A shingle that so many texts of the sample have is frequent; at most MOST_FREQUENT are listed."""
MOST_FREQUENT = 100_000
FOLD = 16
"""Words of 64 bits of the small bitmap by which texts are compared within the join."""


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingle hashes, ascending; a text of fewer words is one shingle, one without words has none."""
    return distinct(shingle_hashes(text, words))


def distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def frequent(docs: DataFrame, id_col: str, text_col: str, words: int) -> np.ndarray:
    """The frequent shingles of a sample drawn by a hash of the id, rarest first."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit("jaccard")), F.lit(1_000_000)) < F.lit(max(1, SAMPLE * 1_000_000 // max(1, n))))

    def run(batches):
        for held in groups_of_rows(batches, 0, BATCH_BYTES):
            for t in as_bytes(held, 0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words))], names=["s"])

    each = some.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "s long")
    top = each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).collect()
    return np.array([r["s"] for r in reversed(top)], np.int64)


def bitmap(own: np.ndarray) -> np.ndarray:
    """The parity of the shingles that fall on each of a power of two bits, at least two a shingle and 64."""
    return parity(own, max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64)


def parity(own: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount(own & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.array([], np.int64)))


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, row (a hash of all columns), node (of the set), fp, size, rare (shingles of the prefix that aren't frequent), prefix in the common order, bits, fold for every row."""
    late = frequent(docs, id_col, text_col, words)
    by_value = np.argsort(late)
    known, (top, bottom) = share(docs.sparkSession, (late[by_value], by_value)), least
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("rare", T.IntegerType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("prefix", "bits", "fold")]])

    def run(batches):
        values, rank = taken(known)
        for held in groups_of_rows(batches, 2, BATCH_BYTES):
            ids, prints, sizes, rare, prefixes, bits, folds = [], [], [], [], [], [], []
            for t in as_bytes(held, 2):
                every = shingle_hashes(t, words)
                prints.append(print_of(every))
                s = distinct(every)
                ids.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                bits.append(bitmap(s))
                folds.append(parity(s, 64 * FOLD))
                keep, few = len(s) + 1 + -len(s) * top // bottom, len(s)
                if len(values) and len(s):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    often = values[at] == s
                    if often.any():
                        few -= int(often.sum())
                        s = np.concatenate([s[~often], s[often][np.argsort(rank[at[often]])]])
                prefixes.append(s[:keep])
                rare.append(min(few, keep))
            ids, prints, row = np.array(ids, np.uint64).view(np.int64), np.array(prints, np.uint64).view(np.int64), 0
            for b in held:
                mine = slice(row, row + b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids[mine]), pa.array(prints[mine]), pa.array(sizes[mine], pa.int32()), pa.array(rare[mine], pa.int32()), _lists(prefixes[mine]), _lists(bits[mine]), _lists(folds[mine])], names=schema.names)
                row += b.num_rows

    text = F.col(f"`{text_col}`").alias("text")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_hash(docs).alias("row"), text).mapInArrow(run, schema)


def sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """node and its shingles (own), of each row of node, text."""

    def run(batches):
        for held in groups_of_rows(batches, 1, BATCH_BYTES):
            own, row = [shingles(t, words) for t in as_bytes(held, 1)], 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(own[row : row + b.num_rows])], names=["node", "own"])
                row += b.num_rows

    return texts.mapInArrow(run, "node long, own array<long>")


def apart_at_least(x: str, y: str) -> Column:
    """In how many places two bitmaps differ; the longer is folded onto the shorter, which is half of it at least."""

    def fold(bits, other):
        half = (F.size(bits) / 2).cast("int")
        halves = F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(bits) > F.size(other), halves).otherwise(bits)

    differ = F.zip_with(fold(F.col(x), F.col(y)), fold(F.col(y), F.col(x)), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differ, F.lit(0), lambda s, n: s + n)


def by_fingerprint(each: DataFrame) -> DataFrame:
    """a, b: nodes of equal fingerprints, in a chain by size, and those of which the segment popcounts and then the bits are near."""
    own = written(each.where("size > 0").select("fp", "size", "node").distinct(), "jaccard-prints")
    before = Window.partitionBy("fp").orderBy("size", "node")
    chain = own.select(F.lag("node").over(before).alias("a"), F.col("node").alias("b")).where("a is not null")
    reps = written(own.groupBy("fp").agg(F.min("node").alias("rep")), "jaccard-reps")
    side = lambda k: reps.select(F.col("fp").alias(k), F.col("rep").alias(f"rep_{k}"))
    near = simhash.links(reps.select("fp")).join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    return chain.unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(each: DataFrame, texts, least: tuple[int, int] = SHARE, words: int = WORDS) -> DataFrame:
    """a, b: links between the nodes of each that keep all connections of sets whose similarity is least or more.

    texts(needed) gives node and text of the nodes needed, again for repeated rows.
    """
    top, bottom = least
    postings = each.where("size > 0").select("node", "size", "rare", F.posexplode("prefix").alias("at", "s"))
    shared = written(postings.groupBy("s").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("s"), "jaccard-shared")
    members = written(postings.join(shared.hint("merge"), "s").distinct(), "jaccard-members")

    def joined(pairs: DataFrame, found: DataFrame, *cols: str) -> DataFrame:
        side = lambda end, k: found.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{k}") for c in cols])
        return pairs.join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), "b")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        pairs = written(pairs.distinct(), f"jaccard-pairs-{name}")
        maps = each.join(ends(pairs).hint("merge"), "node", "left_semi").select("node", "size", "bits").dropDuplicates(["node"])
        close = apart_at_least("bits_x", "bits_y") * (top + bottom) <= (F.col("size_x") + F.col("size_y")) * (bottom - top)
        pairs = written(joined(pairs, maps, "size", "bits").where(close).select("a", "b"), f"jaccard-close-{name}")
        found = written(sets(texts(ends(pairs)), words), f"jaccard-sets-{name}")
        common, sizes = F.size(F.array_intersect("own_x", "own_y")).cast("long"), (F.size("own_x") + F.size("own_y")).cast("long")
        return written(joined(pairs, found, "own").where(common * (top + bottom) >= sizes * top).select("a", "b"), f"jaccard-links-{name}")

    alike = lambda x, y: (x * top <= y * bottom) & (y * top <= x * bottom)
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    before = Window.partitionBy("s").orderBy("size", "node")
    chain = members.select("node", "size", F.lag(F.struct("node", "size")).over(before).alias("other"))
    middle = members.groupBy("s").agg(F.min(F.struct("rare", "node", "size")).alias("other"))
    star = members.join(middle.hint("merge"), "s").select("node", "size", F.struct("other.node", "other.size").alias("other"))
    near = chain.unionByName(star).where(F.col("other.node") != F.col("node")).where(alike(F.col("size"), F.col("other.size")))
    first = verified(near.select(*ordered(F.col("node"), F.col("other.node"))).unionByName(by_fingerprint(each)), "first")
    roots = components(first)
    rooted = members.join(roots.hint("merge"), "node", "left").select("s", "at", "node", "size", F.lag("s").over(Window.partitionBy("node").orderBy("at")).alias("prev"), F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("s")
    folds = each.select("node", *[F.col("fold")[k].alias(f"f{k}") for k in range(FOLD)]).dropDuplicates(["node"])
    apart = written(rooted.join(split.hint("merge"), "s").join(folds.hint("merge"), "node"), "jaccard-apart")
    x, y = apart.alias("x"), apart.alias("y")
    differ = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"x.f{k}").bitwiseXOR(F.col(f"y.f{k}"))) for k in range(FOLD)])
    sizes = F.col("x.size") + F.col("y.size")
    # at the first shingle that two sets share, what comes from there on must suffice
    enough = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) * (top + bottom) >= sizes * top
    # two sets whose shared shingles before this one are the same met there already, with more left
    fresh = F.coalesce(F.col("x.prev") != F.col("y.prev"), F.lit(True))
    on = (F.col("x.s") == F.col("y.s")) & (F.col("x.root") < F.col("y.root")) & alike(F.col("x.size"), F.col("y.size")) & enough & fresh & (differ * (top + bottom) <= sizes * (bottom - top))
    rest = x.join(y, on).select(*ordered(F.col("x.node"), F.col("y.node")))
    return first.unionByName(verified(rest, "rest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = SHARE) -> DataFrame:
    """One row of each component of texts whose similarity is least or more, that with the smallest id. Rows without an id stay.

    Texts without words are alike. Rows of one id are told apart by all their columns.
    """
    each = written(nodes(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, words, least), "jaccard-docs")
    key = [F.col(f"`{id_col}`").alias("doc_id"), row_hash(docs).alias("row")]

    def texts(needed: DataFrame) -> DataFrame:
        rows = each.join(needed, "node").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("node", "r.*")
        keyed = docs.select(*key, F.col(f"`{text_col}`").alias("text"))
        return keyed.join(rows, ["doc_id", "row"]).select("node", "text")

    roots = components(links(each, texts, least, words))
    rows = each.select("doc_id", "row", "node").join(roots.hint("merge"), "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root"))
    best = rows.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("best")).select("best.*")
    return kept_rows(docs, rows, best, id_col)
