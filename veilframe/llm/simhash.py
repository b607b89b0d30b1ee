"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their
popcounts is the embedding. The Manhattan distance of two vectors never exceeds
the Hamming distance of the fingerprints, so links at two bits lie within two in
the embedding. A distance of two touches at most two of five groups of
dimensions: the pair shares the unit grid cell of the other three, so a join on
the ten kinds of such cells finds every pair. The distance in the embedding is
checked next, then the fingerprints themselves.

Equal fingerprints are one node before any of this. A cell with more than
MOST_IN_CELL fingerprints is not paired out: each of its members lists the 65
fingerprints within one bit. Members that list the same one are within two bits
of each other, so linking them to the smallest keeps all connections, in a
number of rows linear in the members.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, checkpoint, groups_of_rows, join_split, written

SHINGLE = 3
HASH_SEED = 42
DISTANCE = 2
MOST_IN_CELL = 48
BATCH_BYTES = 4 << 20
PIECE = 1 << 16
MANY, MOST_HUBS = 1_000, 10_000
"""Keys of more than MANY rows, and of more than one row in MOST_HUBS, are joined by a broadcast of at most MOST_HUBS rows."""
FEW_EDGES = 1_000_000
"""One task can hold so many edges, whatever nodes they are of."""

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOW_BITS = 0x5555555555555555


def shingle_hashes(text: bytes | None, shingle: int) -> list[int]:
    """The hash of each run of so many lower-cased words, repeated ones too; fewer words are one shingle, no words none."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, HASH_SEED)]
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    return [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of lower-cased words, unsigned; no words: 0."""
    return print_of(shingle_hashes(text, shingle))


def print_of(hashes: list[int]) -> int:
    n, ones = len(hashes), None
    if not n:
        return 0
    for k in range(0, n, PIECE):
        part = np.array(hashes[k : k + PIECE], np.uint64).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        ones = bits if ones is None else ones + bits
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (a hash of all columns) and fp (the 64 bits as a long) for every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for held in groups_of_rows(batches, 2, BATCH_BYTES):
            prints = np.array([fingerprint(t, shingle) for t in as_bytes(held, 2)], np.uint64).view(np.int64)
            row = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints[row : (row := row + b.num_rows)])], names=schema.names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_hash(docs).alias("row"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp: Column) -> Column:
    """Popcounts of the two-bit segments in unary (00, 01, 11), so that Manhattan distance is the popcount of an XOR."""
    low, high = fp.bitwiseAND(_LOW_BITS), F.shiftrightunsigned(fp, 1).bitwiseAND(_LOW_BITS)
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def cell_masks() -> list[int]:
    """The bits of each choice of three out of five groups of segments."""
    groups = [sum(3 << (2 * s) for s in range(g, 32, 5)) for g in range(5)]
    return [_signed(a | b | c) for a, b, c in combinations(groups, 3)]


def links(prints: DataFrame, most_in_cell: int = MOST_IN_CELL) -> DataFrame:
    """a, b: links between the distinct fingerprints (column fp) that keep all connections at DISTANCE bits."""
    masks = cell_masks()
    emb = embedding(F.col("fp"))
    cells = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), emb.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)])).alias("c")).select("fp", "c.kind", "c.cell")
    shared = cells.groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    shared = written(shared, "simhash-cells")
    members = written(cells.join(shared.where("n > 2").select("kind", "cell", "n"), ["kind", "cell"]), "simhash-members")
    few = members.where(F.col("n") <= most_in_cell)
    left, right = few.select("kind", "cell", F.col("fp").alias("a")), few.select("kind", "cell", F.col("fp").alias("b"))
    paired = shared.where("n = 2").select("kind", "cell", "a", "b").unionByName(left.join(right, ["kind", "cell"]).where("a < b"))
    apart = embedding(F.col("a")).bitwiseXOR(embedding(F.col("b")))
    first = reduce(lambda rest, km: F.when(apart.bitwiseAND(F.lit(km[1])) == 0, km[0]).otherwise(rest), reversed(list(enumerate(masks))), F.lit(-1))
    near = paired.where(F.bit_count(apart) <= DISTANCE).where(first == F.col("kind")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    crowd = members.where(F.col("n") > most_in_cell).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    # at most 65 fingerprints list one middle
    middles = crowd.select("fp", F.explode(around).alias("middle")).groupBy("middle").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = middles.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b").distinct()
    return near.unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) reaches, for nodes other than it.

    Alternates large and small stars until the edges stay the same; each round is
    cut off in the shared checkpoint folder. Of more than FEW_EDGES edges, nodes with many, of which there can't be many, are broadcast.
    """

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    # joins merge, as tables that are broadcast pass through the driver
    # from here on each edge goes from the larger node a to the smaller b
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    now = state(edges)
    while now[0]:
        lows = lambda e, low, n=now[0]: e.join(low.hint("merge"), F.col("a") == F.col("node")) if n <= FEW_EDGES else join_split(e, "a", low, "node", "n", 2 * n // MOST_HUBS)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count(F.lit(1)).alias("n"))
        large = lows(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        small = lows(large, low)
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b")))
        edges = checkpoint(small.distinct())
        was, now = now, state(edges)
        if was == now:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_in_cell: int = MOST_IN_CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of its component) for every row.

    Texts without words, null ones too, have fingerprint zero and are linked like
    any other. Null ids get a row but name no component unless all ids in it are null
    (then it is null). Repeated rows each get a row. No rows give no rows.
    """
    each = written(fingerprints(docs, id_col, text_col).select("doc_id", "fp"), "simhash-docs")
    prints = written(each.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-prints")
    rows = prints.agg(F.sum("n")).first()[0] or 0
    roots = components(links(prints.select("fp"), most_in_cell))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = linked.join(prints.hint("merge"), F.col("node") == F.col("fp")).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    named = linked.join(least.hint("merge"), "root").select(F.col("fp").alias("node"), "least")
    table = written(prints.join(named.hint("merge"), F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("print"), F.coalesce("least", "rep").alias("component_id"), "n"), "simhash-named")
    # boilerplate's fingerprint may be that of a third of all documents
    return join_split(each, "fp", table, "print", "n", max(MANY, rows // MOST_HUBS)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of fingerprints, that with the smallest id. Rows without an id stay.

    Rows of one id are told apart by all their columns: texts that aren't near copies of any other stay, whatever their ids.
    """
    each = written(fingerprints(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col), "simhash-docs")
    prints = written(each.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("best")), "simhash-prints")
    roots = components(links(prints.select("fp")))
    best = prints.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    return kept_rows(docs, each, best.select("best.*"), id_col)


def kept_rows(docs: DataFrame, each: DataFrame, best: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs that best names by id and hash (doc_id, row), repeated ones once, and those without an id. each: doc_id, row of all."""
    kept = written(each.join(best, ["doc_id", "row"], "left_semi").groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")), "simhash-kept")
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("doc_id"), row_hash(docs).alias("row"))
    once = carried.join(kept.where("n = 1"), ["doc_id", "row"], "left_semi").select("doc.*")
    again = carried.join(kept.where("n > 1"), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"]).select("doc.*")
    return once.unionByName(again).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
