"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs (lines, these into sentences, and what is longer
than PARAGRAPH bytes into pieces). Each digest goes to one cell in each of three
parts of a table; cells hold a count, a sum of digests and a sum of check values. Two
versions' tables subtract cell by cell, and peeling cells of a single digest
recovers the digests in which they differ. Where that fails, pairs are tried
again with larger tables until it succeeds. All pairs of a batch are worked on
together in numpy.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LEAST, Cuts, shuffle_partitions

PARAGRAPH = 200
CELLS = 12
GROWTH = 4
SPARSE = 64
MOST_CELLS = 1 << 20
BATCH_CHARS = 2 << 20

_CUT = re.compile(rb"[^\n.!?]{1,%d}[\n.!?]*|[\n.!?]+" % PARAGRAPH)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1)) * _ODD
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Digests:
    """Digests of the paragraphs of many texts: values, and at[k]:at[k + 1] those of text k. A repeated paragraph gets another for each time."""

    def __init__(self, texts: list[bytes]):
        lists = [_CUT.findall(t) for t in texts]
        self.at = np.cumsum([0, *map(len, lists)])
        h = np.fromiter((xxhash.xxh64_intdigest(p) for x in lists for p in x), np.uint64, self.at[-1])
        owner = np.repeat(np.arange(len(texts)), np.diff(self.at))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))[: len(h)]
        i = np.arange(len(h))
        again = i - np.maximum.accumulate(np.where(new, i, 0)) if len(h) else i
        self.values = h + again.astype(np.uint64) * _ODD
        self.counts = np.diff(self.at)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of the texts listed, and for each the index in the list."""
        n = self.counts[which]
        place = np.repeat(np.arange(len(which)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.values[np.repeat(self.at[which], n) + offset], place


class Tables:
    """One table of cells for each of n texts or pairs."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count, self.sum, self.check = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    def places(self, values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        third = np.uint64(self.cells // 3)
        return np.concatenate([owner * self.cells + (j * (self.cells // 3) + (_mix(values, 7 * self.cells + j + 1) % third).astype(np.int64)) for j in range(3)])

    def add(self, values: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> None:
        """sign: 1 puts in, -1 takes out."""
        to = self.places(values, owner)
        s = np.broadcast_to(np.asarray(sign, np.int64), values.shape)
        np.add.at(self.count, to, np.tile(s, 3))
        u = s.astype(np.uint64)
        np.add.at(self.sum, to, np.tile(values * u, 3))
        np.add.at(self.check, to, np.tile(_mix(values, 0) * u, 3))

    def minus(self, other: Tables) -> Tables:
        out = Tables(self.n, self.cells)
        out.count, out.sum, out.check = self.count - other.count, self.sum - other.sum, self.check - other.check
        return out

    def rows(self, which: np.ndarray) -> Tables:
        out = Tables(len(which), self.cells)
        for k in ("count", "sum", "check"):
            setattr(out, k, getattr(self, k).reshape(self.n, self.cells)[which].reshape(-1))
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Takes digests out until no cell has a single one: how many each table gave, and whether it is empty now."""
        found = np.zeros(self.n, np.int64)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            values = self.sum[look] * sign.astype(np.uint64)
            pure = (np.abs(sign) == 1) & (_mix(values, 0) * sign.astype(np.uint64) == self.check[look])
            look, sign, values = look[pure], sign[pure], values[pure]
            owner = look // self.cells
            # a digest may be single in two or three cells; mixed, as those of a repeated paragraph lie _ODD apart
            _, first = np.unique(_mix(values, 5) + owner.astype(np.uint64) * _ODD, return_index=True)
            sign, values, owner = sign[first], values[first], owner[first]
            np.add.at(found, owner, 1)
            self.add(values, owner, -sign)
            look = np.unique(self.places(values, owner))
        dirty = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        return found, ~dirty.reshape(self.n, self.cells).any(axis=1)

    def names(self) -> list[str]:
        """Each table as text: Base64 of counts, sums and halves of the check values."""
        both = np.empty((self.n, self.cells), np.dtype([("n", "<i4"), ("s", "<u8"), ("c", "<u4")]))
        both["n"], both["s"], both["c"] = (x.reshape(self.n, self.cells) for x in (self.count, self.sum, self.check & np.uint64(0xFFFFFFFF)))
        return [base64.b64encode(r.tobytes()).decode() for r in both]


def tables(digests: Digests, cells: int = CELLS) -> Tables:
    out = Tables(len(digests.counts), cells)
    values, owner = digests.of(np.arange(out.n))
    out.add(values, owner, 1)
    return out


def likeness(digests: Digests, base: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the texts a[k] and b[k] the share of paragraphs in which they don't differ (1 if both have none)."""
    total = digests.counts[a] + digests.counts[b]
    apart, todo, cells = np.zeros(len(a), np.int64), np.arange(len(a)), base.cells
    while len(todo):
        again = []
        for k in range(0, len(todo), step := max(1, MOST_CELLS // cells)):
            part = todo[k : k + step]
            if cells == base.cells:
                diff = base.rows(a[part]).minus(base.rows(b[part]))
            else:
                diff = Tables(len(part), cells)
                for side, sign in ((a, 1), (b, -1)):
                    values, owner = digests.of(side[part])
                    diff.add(values, owner, sign)
            found, ok = diff.peel()
            apart[part[ok]] = found[ok]
            again.append(part[~ok])
        todo, cells = np.concatenate(again), cells * GROWTH
        # a table far larger than both texts that still can't be peeled has digests that collide in every cell
        hopeless = cells > SPARSE * np.maximum(total[todo], CELLS)
        for k in todo[hopeless].tolist():
            x, y = (digests.values[digests.at[i] : digests.at[i + 1]] for i in (a[k], b[k]))
            apart[k] = len(np.setxor1d(x, y))
        todo = todo[~hopeless]
    return np.where(total > 0, 1 - apart / np.maximum(total, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare(texts: list[str]) -> list[tuple]:
    """Rows for all but the last of consecutive texts."""
    n = len(texts) - 1
    plain = [t.encode() for t in texts]
    new = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
    digests = Digests([*plain, *new])
    base = tables(digests)
    names, i = base.names(), np.arange(n)
    near_edited, near_next = likeness(digests, base, i, n + 1 + i), likeness(digests, base, i, i + 1)
    return [(len(t), hashlib.sha256(e).hexdigest(), f, g, x, y) for t, e, f, g, x, y in zip(texts[:n], new, names[:n], names[n + 1 :], near_edited.tolist(), near_next.tolist(), strict=True)]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is that with the next larger id; ids (of any type that can be ordered) that are null come
    first, equal ones order by a hash of the text, and after the last comes the first (a
    single document follows itself). A null text counts as an empty one. No rows give no rows.

    Texts are shuffled once, into ranges of ids, of which one with many rows is cut by the hash of the text. A
    document that begins a range is also sent to the range before, so each task has all the neighbours it needs.
    """
    spark = docs.sparkSession
    few = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_, tie = F.col("doc_id"), F.xxhash64("text")
    ends = few.agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
    low = None if ends["ids"] < ends["n"] else ends["low"]
    first = id_.eqNullSafe(F.lit(low).cast(docs.schema[id_col].dataType))
    least = few.where(first).agg(F.min(tie)).first()[0] if ends["n"] else None
    cuts = Cuts.of(few, id_, tie, shuffle_partitions(spark))
    cuts.pairs = [p for p in cuts.pairs if p != (low, LEAST) and p != (low, least)]  # nothing is below those
    part, last = cuts.below(id_, tie), len(cuts)
    to = F.filter(F.array(F.struct(part.alias("to"), F.lit(0).alias("ahead")), F.when(cuts.begins(id_, tie), F.struct((part - 1).alias("to"), F.lit(1).alias("ahead"))), F.when(first & (tie == F.lit(least)), F.struct(F.lit(last).alias("to"), F.lit(1).alias("ahead")))), lambda x: x.isNotNull())
    sent = few.withColumn("x", F.explode(to)).select("doc_id", "text", "x.to", "x.ahead")
    ranged = sent.repartitionById(last + 1, F.col("to")).sortWithinPartitions("ahead", F.asc_nulls_first("doc_id"), F.xxhash64("text")).select("doc_id", "text", "ahead")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        ids, texts, size = [], [], 0  # texts may have one more than ids: that which follows

        def out():
            cols = list(zip(*compare(texts), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, t) for c, t in zip(cols, arrow, strict=True)]], names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                for i, t, ahead in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    if len(texts) > len(ids):  # the range has ended
                        continue
                    texts.append(t)
                    if ids and (ahead or size >= BATCH_CHARS):
                        yield out()
                        ids, texts, size = [], [t], 0
                    if not ahead:
                        ids.append(i)
                        size += len(t)
        if ids:
            raise RuntimeError("a range of ids came without the document that follows it")

    return ranged.mapInArrow(run, schema)
