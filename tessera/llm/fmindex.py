"""Benchmark decontamination with an FM-index per shard of the training text.

Method: the words of a shard become symbols; words that no benchmark item holds are cut out, because no test phrase
can cross them, so the shard is a set of runs of benchmark words. Over the runs stands an FM-index: suffixes sorted
by prefix doubling, the Burrows-Wheeler column in a wavelet matrix, suffix positions sampled. All test phrases are
searched backwards together; the matching rows are located by walking to the next sampled position; the words of all
occurrences are merged into removal spans.

Defined results: null and empty texts have no words, spans or items; items without words have no phrase; equal items
are each reported, by whole numbers or, for ids of another type, by texts; items without an id are searched like others and
share one null id, which counts as an item and stands in no digest; rows that repeat a key, with one text or several, are searched and cut each for itself; documents of
any length are indexed whole (a shard takes whole documents until its bound); empty tables give empty results; further
columns are carried along, those named like an output are replaced. The benchmark is broadcast in blocks of
``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes; a larger one takes more blocks, each over all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, LongType, StringType, StructField, StructType

from tessera.llm.common import arrow_map, alnum_words, chunks, utf8
from tessera.storage import materialize

WINDOW = 10
#: Benchmark words per FM-index; bytes of text of a batch.
SHARD_SYMBOLS, SHARD_BYTES = 200_000, 1 << 20
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
#: Every so many positions of a run the suffix position is kept.
SAMPLE = 8
#: Names beside columns that are carried along.
TEXT, ROW = "__tessera_text", "__tessera_row"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Phrases:
    """The distinct test phrases of a block of items, and the items of each."""

    def __init__(self, items: list[tuple], window: int):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in alnum_words(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found[tuple(words[i : i + window])].add(item)
        self.words = sorted(found, key=lambda p: (len(p), p))
        self.items = [found[p] for p in self.words]
        self.size = np.array([len(p) for p in self.words], np.int64)
        self.shortest = int(self.size.min()) if self.words else 0
        self.grid = np.zeros((len(self.words), window), np.int64)
        for k, p in enumerate(self.words):
            self.grid[k, window - len(p) :] = p


class WaveletMatrix:
    """Rank of a symbol before a position: one bit vector a level, most significant bit first."""

    def __init__(self, column: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (column >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(column) - self.ones[-1][-1]))
            column = np.concatenate((column[bit == 0], column[bit == 1]))
        self.first = self._starts(np.arange(sigma + 1))

    def _starts(self, symbols: np.ndarray) -> np.ndarray:
        return self._walk(symbols, np.zeros(len(symbols), np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            bit = (symbols >> (self.bits - 1 - k)) & 1
            one = self.ones[k][at]
            at = np.where(bit == 1, self.zeros[k] + one, at - one)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbols, at) - self.first[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these rows, and how many equal ones stand before each."""
        symbols = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            one = self.ones[k][at]
            bit = self.ones[k][at + 1] - one
            symbols = symbols * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + one, at - one)
        return symbols, at - self.first[symbols]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, whose separators (0) count as distinct, the earlier the smaller."""
    n = len(text)
    gaps = text == 0
    rank = text + int(gaps.sum())
    rank[gaps] = np.arange(int(gaps.sum()))
    step = 1
    while True:
        other = np.full(n, -1, np.int64)
        other[:-step] = rank[step:] if step < n else other[:-step]
        key = rank * (n + int(rank.max()) + 2) + other + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FmIndex:
    """Over runs of symbols >= 1, each ended by a separator 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_order(text)
        column = text[order - 1]  # what stands before each suffix; before the first stands the last separator
        self.matrix = WaveletMatrix(column, sigma)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))
        starts = np.concatenate(([True], text[:-1] == 0))  # the walk never leaves a run
        since = np.arange(len(text)) - np.maximum.accumulate(np.where(starts, np.arange(len(text)), 0))
        marked = (since % SAMPLE == 0)[order]
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.kept = order[marked]

    def search(self, grid: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with their ranges of suffix rows; ``grid`` has the phrases right-aligned."""
        live = np.arange(len(grid))
        lo, hi = np.zeros(len(grid), np.int64), np.full(len(grid), self.below[-1])
        done: list[tuple[np.ndarray, ...]] = []
        for k in range(1, grid.shape[1] + 1):
            s = grid[live, -k]
            both = self.matrix.rank(np.concatenate((s, s)), np.concatenate((lo, hi)))
            lo, hi = self.below[s] + both[: len(s)], self.below[s] + both[len(s) :]
            keep = hi > lo
            live, lo, hi = live[keep], lo[keep], hi[keep]
            over = size[live] == k
            done.append((live[over], lo[over], hi[over]))
            live, lo, hi = live[~over], lo[~over], hi[~over]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            at = self.marks[rows]
            hit = self.marks[rows + 1] > at
            out[live[hit]] = self.kept[at[hit]] + walked
            live, rows = live[~hit], rows[~hit]
            symbols, rank = self.matrix.access(rows)
            rows = self.below[symbols] + rank
            walked += 1
        return out


def _merged(words: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive word numbers."""
    if not len(words):
        return []
    cut = np.flatnonzero(np.diff(words) > 1)
    return list(zip(words[np.concatenate(([0], cut + 1))].tolist(), (words[np.concatenate((cut, [len(words) - 1]))] + 1).tolist(), strict=True))


def search_shard(texts: list[list[bytes]], phrases: Phrases) -> list[tuple[np.ndarray, set[int]]]:
    """For each document: the numbers of its words inside occurrences, and the items found."""
    out: list[tuple[np.ndarray, set[int]]] = [(np.empty(0, np.int64), set())] * len(texts)
    get = phrases.ids.get
    parts, places, owners, length = [], [], [], 0
    for d, words in enumerate(texts):
        if not words or not phrases.words:
            continue
        ids = np.fromiter(map(get, words, _ZERO), np.int64, len(words))
        known = np.concatenate(([0], ids != 0, [0]))
        edge = np.flatnonzero(np.diff(known))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= phrases.shortest
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            parts += (ids[a:b], _GAP)
            places.append(np.arange(a, b + 1))
            owners.append((length, d))
            length += b + 1 - a
    if not parts:
        return out
    text, place = np.concatenate(parts), np.concatenate(places)
    index = FmIndex(text, len(phrases.ids))
    found, lo, hi = index.search(phrases.grid, phrases.size)
    if not len(found):
        return out
    count = hi - lo
    which = np.repeat(found, count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    at = index.locate(rows)
    hit = np.zeros(len(text) + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + phrases.size[which], -1)
    inside = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
    starts, docs = np.array([s for s, _ in owners]), np.array([d for _, d in owners])
    owner = lambda x: docs[np.searchsorted(starts, x, side="right") - 1]
    of_hit, pair = owner(inside), np.unique(owner(at) * len(phrases.words) + which)
    items: dict[int, set[int]] = defaultdict(set)
    for d, p in zip((pair // len(phrases.words)).tolist(), (pair % len(phrases.words)).tolist(), strict=True):
        items[d].update(phrases.items[p])
    for d, have in items.items():
        out[d] = (place[inside[of_hit == d]], have)
    return out


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZERO, _GAP = _Zeros(), np.zeros(1, np.int64)
NAMES = n_words, hit_words, item_ids = tuple(f"__tessera_{n}" for n in ("n_words", "hit_words", "item_ids"))


def _kind(benchmark: DataFrame, item: str) -> DataType:
    """Whole-numbered ids stay such, others are texts."""
    return LongType() if isinstance(benchmark.schema[item].dataType, IntegralType) else StringType()


def _found(kind: DataType) -> list[StructField]:
    spans = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    return [StructField(n, t) for n, t in zip(NAMES, (LongType(), spans, ArrayType(kind)), strict=True)]


def _in_order(ids) -> list:
    """Ids sorted, a null one first."""
    return sorted(ids, key=lambda i: (i is not None, i))


def _blocks(benchmark: DataFrame, item: str, text: str):
    """Lists of (item, bytes) within the two bounds; items come over one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast(_kind(benchmark, item)), utf8(text)).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(row[1]) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row[0], bytes(row[1])))
        size += len(row[1])
    yield block


def find_phrases(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, hit_words array<struct<start,end>> in word numbers, item_ids) for every document."""
    found = _searched(docs.select(F.col(key), F.col(text).alias(TEXT)), TEXT, _blocks(benchmark, item, item_text), _kind(benchmark, item), window)
    return found.select(key, *(F.col(n).alias(n.removeprefix("__tessera_")) for n in NAMES))


def _searched(docs: DataFrame, text: str, blocks: Iterator, kind: DataType, window: int, cut: bool = False) -> DataFrame:
    """``docs`` with the columns of NAMES, each under a name of its own, row by row: rows never meet by their keys.
    ``cut``: with the hit words gone from ``text``."""
    first, second = next(blocks), next(blocks, None)
    if second is None:  # the cut needs no pass, and no Python worker, of its own
        return _search(docs, text, first, kind, window, cut)
    out = _over_blocks(docs, text, chain((first, second), blocks), kind, window)
    if not cut:
        return out
    spans = F.col(hit_words)
    hit, clean = F.size(spans) > 0, F.udf(cut_words, "string", useArrow=True)
    return out.withColumn(text, F.when(hit, clean(F.when(hit, F.col(text)), F.when(hit, spans))).otherwise(F.col(text)))


def _over_blocks(docs: DataFrame, text: str, blocks: Iterator, kind: DataType, window: int) -> DataFrame:
    """Each block is searched over the rows' numbers and texts, and what it finds in a row merges once more."""
    rows = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "documents")
    slim = rows.select(ROW, text)
    results = [_search(slim, text, block, kind, window).drop(text) for block in blocks]
    both = materialize(reduce(DataFrame.unionByName, (r.withColumn("block", F.lit(k)) for k, r in enumerate(results))), "phrases")
    hits = both.where(F.size(item_ids) > 0)
    w = Window.partitionBy(ROW).orderBy("start", "end")
    spans = hits.select(ROW, F.explode(hit_words).alias("s")).select(ROW, "s.*")
    spans = spans.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w))
    spans = spans.groupBy(ROW, "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(hit_words))
    items = hits.groupBy(ROW).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(item_ids)))).alias(item_ids))
    none = lambda f: F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name)
    merged = both.where("block = 0").select(ROW, n_words).join(spans, ROW, "left").join(items, ROW, "left")
    return rows.join(merged, ROW).select(*docs.columns, n_words, *map(none, _found(kind)[1:]))


def _search(docs: DataFrame, text: str, block: list[tuple], kind: DataType, window: int, cut: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = [*docs.columns, *NAMES]
    schema, ids = StructType([*docs.schema.fields, *_found(kind)]), pa.list_(pa.int64() if kind == LongType() else pa.string())

    def run(batches):
        phrases = Phrases(shared.value, window)
        for b in chunks(batches, text, SHARD_BYTES):
            texts = [alnum_words(t) for t in b.column(text).fill_null("").cast(pa.binary()).to_pylist()]
            found: list = []
            some, symbols = [], 0
            for words in texts:
                some.append(words)
                symbols += len(words)
                if symbols >= SHARD_SYMBOLS:
                    found += search_shard(some, phrases)
                    some, symbols = [], 0
            found += search_shard(some, phrases)
            spans = [[{"start": x, "end": y} for x, y in _merged(h)] for h, _ in found]
            columns = list(b.columns)
            if cut and any(spans):
                at = b.schema.get_field_index(text)
                columns[at] = pa.array([cut_words(t, s) for t, s in zip(b.column(at).to_pylist(), spans, strict=True)], b.column(at).type)
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([_in_order(i) for _, i in found], ids),
                ],
                names,
            )

    return arrow_map(docs, run, schema)


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    spans = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        key, "n_words", spans.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def cut_words(text: str | None, spans: list | None) -> str | None:
    """``text`` without the words of these spans (in word numbers) and the punctuation right after them."""
    if not text or not spans:
        return text
    raw, at, out = text.encode(), 0, []
    where = [m.span() for m in _WORD.finditer(raw)]
    for s in spans:
        out.append(raw[at : where[s["start"]][0]].rstrip(b" "))
        at = where[s["end"] - 1][1]
        while at < len(raw) and raw[at : at + 1] in b".,;:!?":
            at += 1
    return b"".join([*out, raw[at:]]).decode()


def remove_phrases(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the contaminated spans cut out of ``text`` (and ``n_chars``, if there, counted again), each row by
    its own spans: the key is not read."""
    out = _searched(docs, text, _blocks(benchmark, item, item_text), _kind(benchmark, item), window, cut=True)
    if "n_chars" in docs.columns and text != "n_chars":
        counted = F.length(text).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size(hit_words) > 0, counted).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
