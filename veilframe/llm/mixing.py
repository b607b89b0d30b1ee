"""Mixing sources to target weights by Poisson replication.

A source of n documents that should make up a share w of the mixture gets the
mean repetition rate w * total / n. Each document inverts the Poisson
distribution of that mean at a uniform number hashed from its id, is exploded by
the count, and its copies are dealt to partitions by the high bits of a hash of
their own and sorted by it, which shuffles them globally without a sampling pass.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_counted, shuffle_partitions, written

SEED = 17
ALPHA = 0.5
MOST_SOURCES = 10_000
PIECE = 500.0
"""Means above this are drawn as sums of equal independent parts, as exp(-mean) would underflow."""


def rates(docs: DataFrame, source_col: str = "source", weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, total: int | None = None) -> DataFrame:
    """source, n, rate: by weights, or in proportion to n ** alpha. A null source is one of its own, None in weights;
    sources that weights does not name have weight 0."""
    source = F.col(f"`{source_col}`")
    n = written(docs.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n")), "mix-sources")
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        given = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        named = F.coalesce(F.element_at(F.create_map(*given), F.col("source")), F.lit(0.0)) if given else F.lit(0.0)
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0)))).otherwise(named)
    n = n.withColumn("w", weight)
    sums = n.agg(F.sum("n").alias("rows"), F.sum("w").alias("all_w")).first()
    size, all_w = float(total if total is not None else sums["rows"] or 0), float(sums["all_w"] or 0)
    return n.select("source", "n", (F.col("w") / F.lit(all_w or 1.0) * F.lit(size) / F.col("n")).alias("rate"))


def _unit(text: Column) -> Column:
    """A uniform number in [0, 1) of 52 bits of MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2 ..., as far as doubles tell them from 1."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 12).cast("int"))
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(steps, start, step, lambda s: s["all"])


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: Mapping[str, float] | None = None, alpha: float = ALPHA, total: int | None = None, seed: int = SEED, keep_keys: bool = True) -> DataFrame:
    """docs, each row as often as its draw says, in a global order of hashes.

    With keep_keys, copy (from 1) and mix_key (ascending in that order) follow; they
    take other names if docs has these. A null id is replaced by the text when
    hashing. Rows of one id draw alike. An empty table stays empty. Rates of up to
    MOST_SOURCES sources are broadcast. Of more, those with the most documents are, and only
    rows of others, none of which has many, are joined by a shuffle.
    """
    spark, seen = docs.sparkSession, docs.columns
    copy, key = free_name(seen, "copy"), free_name(seen, "mix_key")
    parts = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    table = rates(docs, source_col, weights, alpha, total).withColumn("parts", parts)
    table = table.select("source", "n", "parts", _distribution(F.col("rate") / F.col("parts")).alias("at_most"))
    # the row is kept in a struct, so that no name of docs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in seen]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"), F.lit("")).alias("ident"), F.col(f"`{source_col}`").alias("by"))
    drawn = join_counted(rows, "by", table, "source", "n", MOST_SOURCES, nulls=True)

    def draw(j):
        u = _unit(F.concat(F.lit(f"{seed}:"), j.cast("string"), F.lit(":"), F.col("ident")))
        return F.size(F.filter("at_most", lambda c: c <= u))

    times = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), draw), F.lit(0), lambda a, b: a + b)
    drawn = drawn.select("row", "ident", times.alias("times")).where("times > 0")
    copies = drawn.select("row", "ident", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:order:"), F.col("copy").cast("string"), F.lit(":"), F.col("ident"))), 1, 13), 16, 10).cast("long")
    n = shuffle_partitions(spark)
    dealt = copies.select("row", "copy", hashed.alias("key")).repartitionById(n, F.floor(F.col("key") / F.lit(float(1 << 52)) * n).cast("int")).sortWithinPartitions("key")
    own = [F.col("row").getField(c).alias(c) for c in seen]
    return dealt.select(*own, F.col("copy").alias(copy), F.col("key").alias(key)) if keep_keys else dealt.select(*own)
