"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased letters with single gaps between words; their 1- to
3-grams are hashed to BUCKETS. Counts are added up by language in the JVM, the
matrix of log probabilities (languages x BUCKETS) is broadcast, and whole
batches of texts are scored in numpy by gathering a number for each n-gram and
adding up by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, groups_of_rows, map_arrow, share, taken

BUCKETS = 1 << 16
ORDERS = 3
SMOOTHING = 0.5
MOST_TRAINING = 20_000
"""About how many labelled documents the model is fitted on, drawn by a hash of doc_id; scoring reads all."""
MOST_LANGUAGES = 200
"""The matrix of so many is 0.1 GB."""
BATCH_BYTES = 2 << 20
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point of the BMP its lower-case letter, or 0."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(0x10000)], np.uint32)


def _fold(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    high = codes >= 0x10000
    out = table[np.where(high, 0, codes)]
    if high.any():
        found, where = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in found.tolist()], np.uint32)[where]
    return out


def features(texts: list[bytes | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (orders x positions; BUCKETS where an n-gram would leave its text), each text's first position, and whether it has letters."""
    strings = [(t or b"").decode("utf-8", "replace") for t in texts]
    codes = np.frombuffer((" " + "  ".join(strings) + " ").encode("utf-32-le", "replace"), np.uint32)
    starts = np.cumsum([0, *(len(s) + 2 for s in strings[:-1])])
    c = _fold(codes, table)
    keep = (c != 0) | np.concatenate(([True], c[:-1] != 0))
    keep[starts] = True
    place = np.cumsum(keep) - 1
    starts, c = place[starts], c[keep].astype(np.uint64)
    ends = np.append(starts[1:], len(c))
    last = np.repeat(ends, np.diff(np.append(starts, len(c))))
    letters = np.add.reduceat((c != 0).astype(np.int64), starts) > 0
    out, h, at = np.empty((ORDERS, len(c)), np.int32), np.zeros(len(c), np.uint64), np.arange(len(c))
    padded = np.append(c, np.zeros(ORDERS, np.uint64))
    for n in range(1, ORDERS + 1):
        h = (h + padded[n - 1 : n - 1 + len(c)] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out[n - 1] = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int32)
        out[n - 1][at + n > last] = BUCKETS
    return out, starts, letters


class Model:
    """Languages and the log probability of each bucket; the last column, for no n-gram, is 0."""

    def __init__(self, counts: dict[str, np.ndarray], docs: dict[str, int]):
        self.languages = sorted(docs)
        self.log = np.zeros((len(self.languages), BUCKETS + 1))
        for k, lang in enumerate(self.languages):
            n = counts.get(lang, np.zeros(BUCKETS)) + SMOOTHING
            self.log[k, :BUCKETS] = np.log(n / n.sum())
        total = sum(docs.values())
        self.prior = np.log([docs[x] / total for x in self.languages])

    def predict(self, texts: list[bytes | None], table: np.ndarray) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        buckets, starts, letters = features(texts, table)
        scores = np.empty((len(self.languages), len(texts)))
        for k, log in enumerate(self.log):
            each = log[buckets[0]]
            for b in buckets[1:]:
                each += log[b]
            scores[k] = np.add.reduceat(each, starts) + self.prior[k]
        best = scores.argmax(axis=0)
        sure = 1 / np.exp(scores - scores.max(axis=0)).sum(axis=0)
        return [self.languages[b] if x else UNKNOWN for b, x in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, sure, 0.0).tolist()


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_TRAINING) -> Model:
    """Learns from texts with a language and an id that isn't held out, about most of them.

    Each task counts n-grams by language, the JVM adds the counts up, and the driver
    gets BUCKETS numbers for each of at most MOST_LANGUAGES languages.
    """
    usable = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    n, different = usable.agg(F.count(F.lit(1)), F.approx_count_distinct(f"`{lang_col}`")).first()
    if different > MOST_LANGUAGES // 2 and (different := usable.select(f"`{lang_col}`").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{different} languages; the matrix that is broadcast is for {MOST_LANGUAGES} at most")
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64(F.lit("langid"), f"`{id_col}`"), F.lit(1_000_003)) < int(1_000_003 * most / n))

    def count(batches):
        table, sums, seen = _letters(), {}, {}
        for held in groups_of_rows(batches, 1, BATCH_BYTES):
            langs = [x for b in held for x in b.column(0).to_pylist()]
            buckets, starts, letters = features(as_bytes(held, 1), table)
            names = sorted(set(langs))
            own = np.array([names.index(x) for x in langs])
            who = np.repeat(own, np.diff(np.append(starts, buckets.shape[1])))
            hist = sum(np.bincount(who * (BUCKETS + 1) + b, minlength=len(names) * (BUCKETS + 1)) for b in buckets).reshape(len(names), -1)
            for k, name in enumerate(names):
                sums[name] = sums.get(name, 0) + hist[k, :BUCKETS]
                seen[name] = seen.get(name, 0) + int((letters & (own == k)).sum())
        for name, all_ in sums.items():
            some = np.flatnonzero(all_)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(some) + 1), pa.string()), pa.array([-1, *some.tolist()], pa.int32()), pa.array([seen[name], *all_[some].tolist()], pa.int64())], names=["lang", "bucket", "n"])

    found = usable.select(f"`{lang_col}`", f"`{text_col}`").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang: dict[str, np.ndarray] = {}
    docs_of: dict[str, int] = {}
    got = found.toPandas()
    for lang, rows in got.groupby("lang"):
        plain = rows[rows["bucket"] >= 0]
        n_docs = int(rows.loc[rows["bucket"] < 0, "n"].sum())
        if n_docs:
            by_lang[lang] = np.bincount(plain["bucket"], weights=plain["n"], minlength=BUCKETS)
            docs_of[lang] = n_docs
    return Model(by_lang, docs_of)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; a text that is null or has no letters is und with score 0."""
    shared = share(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        table, model = _letters(), taken(shared)
        for held in groups_of_rows(batches, 2, BATCH_BYTES):
            langs, sure = model.predict(as_bytes(held, 2), table)
            row = 0
            for b in held:
                rows = slice(row, row := row + b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs[rows], pa.string()), pa.array(sure[rows], pa.float64())], names=schema.names)

    few = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return few.mapInArrow(score, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """docs without texts that are und, score below least, or are in none of the wanted languages (None: all learned)."""
    shared, at = share(docs.sparkSession, model), docs.columns.index(text_col)

    def kept(batches):
        table, model = _letters(), taken(shared)
        for held in groups_of_rows(batches, at, BATCH_BYTES):
            langs, sure = model.predict(as_bytes(held, at), table)
            good = [x != UNKNOWN and s >= least and (wanted is None or x in wanted) for x, s in zip(langs, sure, strict=True)]
            row = 0
            for b in held:
                some = b.filter(pa.array(good[row : (row := row + b.num_rows)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(some.columns, names=names)

    names = docs.columns
    return map_arrow(docs, kept, docs.schema)
