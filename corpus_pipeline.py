"""A training corpus in five stages, each over all that its predecessor kept.

run() writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import decontam, jaccard, langid, mixing, sharding
from veilframe.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those that no learned language explains."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near copies: SimHash over five-word shingles finds them by segment
    popcounts, the shingles themselves decide (a Jaccard similarity of 0.8 or more), and a join on these finds what fingerprints miss."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth or more."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents toward source weights in proportion to the square root of what each source has, in a global random order."""
    return mixing.mix(docs, keep_keys=False)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every copy into one of eight shards of near equal size, cut from the texts in a seeded random order, so that each shard has the mixture."""
    return sharding.assign(docs, carry=("lang", "source"), order_seed=mixing.SEED)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: SQL can express neither the classifier nor the fingerprints and CRC-32; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
