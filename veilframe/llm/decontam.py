"""Benchmark decontamination with one FM-index for each shard of training text.

Each task cuts its rows into shards, sorts the suffixes of a shard's word
sequence, keeps the Burrows-Wheeler transform as a wavelet tree (one bit vector
a level) and finds every benchmark window by backward search. Occurrences are
located by walking to the nearest sampled suffix position; spans merge by
document. Nothing is shuffled, and documents never meet on one machine.

The index has an alphabet of the benchmark's words. Runs of other words, which
no window can cross, stand as one separator; separators sort by position, so
comparing suffixes ends at the first one.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, free_name, groups_of_rows, map_arrow, share, taken

WINDOW = 13
SHARE = 20
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
SAMPLE = 8

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and takes [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 text; null has none."""
    return text.translate(_KEEP).split() if text else []


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the count before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        got = np.packbits(bits, bitorder="little")
        packed[: len(got)] = got
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1]))
        self.ones = int(ones.sum())
        self.zeros = n - self.ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        k = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k] + np.bitwise_count(self.words[k] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Level-wise wavelet tree: each level holds one bit of every symbol, zeros before ones on the next."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels, seq = [], symbols
        self.depth = max(1, int(n_symbols - 1).bit_length())
        for b in range(self.depth - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            self.levels.append((b, Bits(bit)))
            seq = np.concatenate((seq[~bit], seq[bit]))
        every = np.arange(n_symbols, dtype=np.int64)
        self.start = self._down(every, np.zeros(n_symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, bits in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> b) & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        return self._down(c, i) - self.start[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how many of it stand before."""
        c = np.zeros(len(i), np.int64)
        for b, bits in self.levels:
            bit, ones = bits.get(i), bits.rank(i)
            c |= bit.astype(np.int64) << b
            i = np.where(bit, bits.zeros + ones, i - ones)
        return c, i - self.start[c]


def suffix_order(first: np.ndarray) -> np.ndarray:
    """Rank of every suffix. first: the rank that its first symbol gives, as the start of its group of equals.

    Prefix doubling that sorts again only what is still tied. The last symbol is unique.
    """
    n, rank, h = len(first), first.astype(np.int64), 1
    sizes = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(sizes[rank] > 1)
    while len(open_):
        old = rank[open_]
        key = old * n + rank[np.minimum(open_ + h, n - 1)]
        order = np.argsort(key)
        open_, key, old = open_[order], key[order], old[order]
        at = np.arange(len(key))
        new_group = np.concatenate(([True], key[1:] != key[:-1]))
        old_group = np.concatenate(([True], old[1:] != old[:-1]))
        begins = np.maximum.accumulate(np.where(new_group, at, 0))
        rank[open_] = old + begins - np.maximum.accumulate(np.where(old_group, at, 0))
        ends = np.concatenate((new_group[1:], [True]))
        open_ = open_[~(new_group & ends)]
        h *= 2
    return rank


class FMIndex:
    """Counts and locates word sequences in a sequence whose zeros are separators; it must end with one."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        n = len(seq)
        counts = np.bincount(seq, minlength=n_symbols)
        self.below = np.concatenate(([0], np.cumsum(counts)))
        sep = seq == 0
        first = np.where(sep, np.cumsum(sep) - 1, self.below[seq])
        rank = suffix_order(first)
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        bwt = seq[sa - 1]
        self.tree = WaveletTree(bwt, n_symbols)
        kept = (sa % sample == 0) | (bwt == 0)
        self.sampled, self.samples = Bits(kept), sa[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all rows of patterns at once: which occur, and their ranges of suffixes."""
        alive, c = np.arange(len(patterns)), patterns[:, -1]
        lo, hi = self.below[c], self.below[c + 1]
        for k in range(patterns.shape[1] - 2, -2, -1):
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if k < 0 or not len(alive):
                break
            c = patterns[alive, k]
            both = self.tree.rank(np.concatenate((c, c)), np.concatenate((lo, hi))) + np.tile(self.below[c], 2)
            lo, hi = both[: len(c)], both[len(c) :]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to the nearest sampled one."""
        out, todo, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.sampled.get(rows)
            out[todo[done]] = self.samples[self.sampled.rank(rows[done])] + steps
            todo, rows = todo[~done], rows[~done]
            if len(todo):
                c, before = self.tree.access(rows)
                rows = self.below[c] + before
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, over an alphabet of their words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if ids:
                for i in range(max(1, len(ids) - window + 1)):
                    found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == n]
            self.by_length[n] = np.array(own, np.int64), [sorted(found[w]) for w in own]


def scan_shard(texts: list[bytes | None], phrases: Phrases, sample: int = SAMPLE):
    """For each text: words, spans [start, end) of hit words, items. One FM-index over all of them."""
    get, parts, starts, n_words, at = phrases.vocab.get, [np.zeros(1, np.int32)], [], [], 1
    for text in texts:
        words = words_of(text)
        starts.append(at)
        n_words.append(len(words))
        parts += [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)), np.zeros(1, np.int32)]
        at += len(words) + 1
    seq, starts_ = np.concatenate(parts), np.array(starts)
    del parts
    source = np.flatnonzero((seq != 0) | np.concatenate(([True], seq[:-1] != 0)))
    short = seq[source].astype(np.int64)
    if short[-1]:
        short, source = np.append(short, 0), np.append(source, len(seq))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if len(short) > 1 and phrases.by_length:
        index = FMIndex(short, len(phrases.vocab) + 1, sample)
        edge = np.zeros(len(seq) + 1, np.int64)
        any_hit = False
        for n, (patterns, owners) in phrases.by_length.items():
            which, lo, hi = index.search(patterns)
            if not len(which):
                continue
            any_hit, count = True, hi - lo
            first = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            where = source[index.locate(first + np.arange(count.sum()))]
            np.add.at(edge, where, 1)
            np.add.at(edge, where + n, -1)
            doc = np.searchsorted(starts_, where, side="right") - 1
            for key in np.unique(doc * len(patterns) + np.repeat(which, count)).tolist():
                items[key // len(patterns)].update(owners[key % len(patterns)])
        if any_hit:
            hit = (np.cumsum(edge) > 0).astype(np.int8)
            turn = np.diff(hit, prepend=np.int8(0))
            begins, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            doc = np.searchsorted(starts_, begins, side="right") - 1
            for d, s, e in zip(doc.tolist(), (begins - starts_[doc]).tolist(), (ends - starts_[doc]).tolist(), strict=True):
                spans[d].append((s, e))
    return n_words, spans, items


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of spans; spans that touch join."""
    out: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pieces(text: bytes, window: int, most: int):
    """A text in pieces of about most bytes that share window - 1 words, so that each of its windows is in one of them."""
    if len(text) <= most:
        yield text
        return
    words = words_of(text)
    step = max(1, most * len(words) // len(text))
    for i in range(0, max(1, len(words) - window + 1), step):
        yield b" ".join(words[i : i + step + window - 1])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int):
    """Benchmark rows in blocks of bounded size, one at a time; a longer item is spread over several."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    for i, t in rows.toLocalIterator():
        for data in _pieces(t.encode(), window, block_bytes):
            if block and size + len(data) > block_bytes:
                yield block
                block, size = [], 0
            block.append((i, data))
            size += len(data)
    yield block


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """docs with four more columns, named by the second result: words (long), spans (array of word
    ranges), hits (long) and items (array of strings).

    A benchmark beyond block_bytes is searched block by block, each a further step of the same tasks. A null text
    has no words; a null item id reads "null"; repeated rows each get a row; columns of docs keep
    their names, whatever these are. No rows give no rows; an empty benchmark hits nothing.
    """
    names = {k: free_name(docs.columns, f"dc_{k}") for k in ("words", "spans", "hits", "items")}
    fields = [T.StructField(names["words"], T.LongType()), T.StructField(names["spans"], T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField(names["hits"], T.LongType()), T.StructField(names["items"], T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *fields])
    at, width, out = docs.columns.index(text_col), len(docs.columns), docs
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes, window)):
        shared = share(docs.sparkSession, Phrases(block, window))

        def scan(batches, shared=shared, first=k == 0):
            phrases = taken(shared)
            for held in groups_of_rows(batches, at, shard_bytes):
                n_words, spans, items = scan_shard(as_bytes(held, at), phrases)
                if not first:
                    was = [[(x["start"], x["end"]) for x in v or ()] for b in held for v in b.column(width + 1).to_pylist()]
                    spans = [merged(a, b) for a, b in zip(was, spans, strict=True)]
                    items = [s | set(v or ()) for s, v in zip(items, (v for b in held for v in b.column(width + 3).to_pylist()), strict=True)]
                row = 0
                for b in held:
                    rows = slice(row, row := row + b.num_rows)
                    more = [pa.array(n_words[rows], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in v] for v in spans[rows]], _SPANS), pa.array([sum(e - s for s, e in v) for v in spans[rows]], pa.int64()), pa.array([sorted(v) for v in items[rows]], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*b.columns[:width], *more], names=[f.name for f in schema.fields])

        out = map_arrow(out, scan, schema)
    return out, names


def contaminated(names: dict[str, str], share: int = SHARE):
    """A hit, and at least one word in share hit."""
    hits, words = F.col(f"`{names['hits']}`"), F.col(f"`{names['words']}`")
    return (hits > 0) & (share * hits >= words)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: one row for each document."""
    few = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out, names = annotate(few, benchmark, window=window)
    sha = F.sha2(F.concat_ws(",", names["items"]), 256)
    return out.select("doc_id", F.col(names["words"]).alias("n_words"), F.col(names["hits"]).alias("n_hit"), F.size(names["items"]).cast("long").alias("n_items"), sha.alias("items_sha256"), contaminated(names, share).alias("contaminated"), F.transform(names["spans"], lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))).alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """docs without the contaminated ones, columns unchanged."""
    out, names = annotate(docs, benchmark, text_col=text_col, window=window)
    return out.where(~contaminated(names, share)).select(*[F.col(f"`{c}`") for c in docs.columns])


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between these."""
    places, out, last = [m.span() for m in _WORD.finditer(text)], [], 0
    for start, end in spans:
        out.append(text[last : places[start][0]])
        last = places[end - 1][1]
    return b"".join([*out, text[last:]])


def cut(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the merged spans of hit words removed from their texts, columns unchanged. For corpora that would rather lose passages than documents."""
    out, names = annotate(docs, benchmark, text_col=text_col, window=window)
    at, spans, columns = docs.columns.index(text_col), out.columns.index(names["spans"]), docs.columns

    def run(batches):
        for b in batches:
            texts = zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(spans).to_pylist(), strict=True)
            new = [t if not s else without(t, [(x["start"], x["end"]) for x in s]) for t, s in texts]
            own = list(b.columns[: len(columns)])
            own[at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(own, names=columns)

    return map_arrow(out, run, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
