"""Helpers that several operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_dir

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
"""Words before A-Z are lower-cased; after that the class is [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]."""


LEAST = -(1 << 63)
"""The smallest long."""
SEED = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder, which outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any name; it can't resolve names with dots itself."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, schema)


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcasts a value of this package's own classes, with the classes; taken() reads it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def taken(shared: Broadcast):
    return cloudpickle.loads(shared.value)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Cuts:
    """Ascending pairs (id, tie) that cut the rows of a table into ranges of about equal size. Null ids come first.

    ids may be of any type that can be ordered. tie is a long that tells rows of one id apart, so
    that neither an id with many rows nor rows without one make a range of their own.
    """

    def __init__(self, pairs: list[tuple], kind: T.DataType):
        self.pairs, self.kind = pairs, kind

    @classmethod
    def of(cls, df: DataFrame, id_: Column, tie: Column, parts: int) -> Cuts:
        """At most parts - 1 pairs that rows of df have, from a random sample of about 20 a range (2,000 at least).

        The ids alone are read, unless one of them spans a cut.
        """
        kind, n = df.select(id_).schema[0].dataType, df.count() if parts > 1 else 0
        if not n:
            return cls([], kind)
        share = min(1.0, max(2_000, 20 * parts) / n)
        some = df if share == 1.0 else df.where(F.rand(SEED) < share)

        def picked(*cols):
            rows = sorted((r[0] is not None, *r) for r in some.select(*cols).collect())
            return [rows[k * len(rows) // parts][1:] for k in range(1, parts)] if rows else []

        found = [(i, LEAST) for i, in picked(id_)]
        if len(set(found)) < len(found):
            found = picked(id_, tie)
        return cls(list(dict.fromkeys(found)), kind)

    def __len__(self) -> int:
        return len(self.pairs)

    def _listed(self, pairs: list[tuple]) -> Column:
        return F.array(*[F.struct(F.lit(i).cast(self.kind).alias("i"), F.lit(t).cast("long").alias("t")) for i, t in pairs])

    def below(self, id_: Column, tie: Column) -> Column:
        """How many pairs are at or below that of a row. Two levels, so it is compared with about twice the square root of their number."""
        if not self.pairs:
            return F.lit(0)

        def passed(p):
            return F.coalesce(p["i"] < id_, p["i"].isNull() & id_.isNotNull()) | p["i"].eqNullSafe(id_) & (p["t"] <= tie)

        step = max(1, int(len(self.pairs) ** 0.5))
        start = F.greatest((F.size(F.filter(self._listed(self.pairs[::step]), passed)) - 1) * step, F.lit(0))
        return (start + F.size(F.filter(F.slice(self._listed(self.pairs), start + 1, step), passed))).cast("int")

    def begins(self, id_: Column, tie: Column) -> Column:
        """Whether a row has the pair of a cut, or may have it."""
        if not self.pairs:
            return F.lit(False)
        whole = [i for i, t in self.pairs if t == LEAST]
        parted = [p for p in self.pairs if p[1] != LEAST]
        out = F.lit(False)
        if whole:
            some = [i for i in whole if i is not None]
            out = F.coalesce(id_.isin(some), F.lit(False)) if some else F.lit(False)
            if len(some) < len(whole):
                out = out | id_.isNull()
        if parted:
            out = out | F.exists(self._listed(parted), lambda p: p["i"].eqNullSafe(id_) & (p["t"] == tie))
        return out


def join_split(rows: DataFrame, by: str, table: DataFrame, key: str, n: str, many: int, nulls: bool = False) -> DataFrame:
    """rows with the columns of table (a row for each key, with the number n of its rows) where by is key; with nulls, null is a key.

    Keys of more than `many` rows are broadcast; there are no more of these than `many` goes into the number of
    rows, and the caller chooses it so that this is a bounded number. Other rows, whose keys are evenly spread, meet by a shuffle.
    """
    slim = table.select(F.col(key).alias("__key"), F.col(n).alias("__n"), *[c for c in table.columns if c not in (key, n)])
    head = F.broadcast(slim.where(F.col("__n") > many))
    rest = rows.join(head.select("__key"), _same(rows[by], nulls), "left_anti")
    both = [left.join(right, _same(left[by], nulls)) for left, right in ((rows, head), (rest, slim))]
    return both[0].unionByName(both[1]).drop("__key", "__n")


def _same(by: Column, nulls: bool) -> Column:
    return by.eqNullSafe(F.col("__key")) if nulls else by == F.col("__key")


def join_counted(rows: DataFrame, by: str, table: DataFrame, key: str, n: str, most: int, nulls: bool = False) -> DataFrame:
    """As join_split, in one pass over rows if the table has up to `most` keys: these are broadcast then."""
    few = table.limit(most + 1).collect()
    if len(few) <= most:
        cols = [c for c in table.columns if c not in (key, n)]
        head = rows.sparkSession.createDataFrame(few, table.schema).select(F.col(key).alias("__key"), *cols)
        return rows.join(F.broadcast(head), _same(rows[by], nulls)).drop("__key")
    return join_split(rows, by, table, key, n, (table.agg(F.sum(n)).first()[0] or 0) // most, nulls)


def free_name(taken: list[str], name: str) -> str:
    """A column name that no given column has, whatever its case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def groups_of_rows(batches, text_index: int, most_bytes: int, most_rows: int = 20_000):
    """Cuts a stream of record batches into lists of slices of about most_bytes of text each; a longer text stands alone."""
    held, n_bytes, n_rows = [], 0, 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_pylist()
        start = 0
        for i, size in enumerate(lengths):
            if (n_bytes and n_bytes + size > most_bytes) or n_rows >= most_rows:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield held
                held, n_bytes, n_rows, start = [], 0, 0, i
            n_bytes += size
            n_rows += 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield held


def as_bytes(batches: list[pa.RecordBatch], index: int) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return [x for b in batches for x in b.column(index).cast(pa.binary()).to_pylist()]
