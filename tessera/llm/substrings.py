"""Removal of repeated passages by hashing text units.

Method: a text is cut into lines, and lines into units at sentence ends and before capitalised words (a unit of over
LONG_UNIT words is cut again after words chosen by their checksum, so equal passages are cut alike). A unit is
normalised to its lower-case alphanumeric words and digested (128 bits). Digests are grouped globally; the occurrence
of the lowest (key, position) stays. All others are marked; marked units that follow each other form runs, and runs of
MIN_WORDS words or more are removed. Units of fewer than TINY words that follow each other (one-word lines, "WORD!!
WORD!!") are merged first, cut where the checksum of one is the lowest among its REACH neighbours on either side, so equal
lists are cut alike wherever they stand. What stays below TINY words, alone between longer units, is not digested; it
joins the marked units around it. In scripts without blanks units end at their own full stops, and two letters count as a
word. Offsets of what was removed refer to the original text.

Each task first resolves the repeats inside its own batches and remembers the least occurrence of RECENT digests, so a
unit that a third of all documents share arrives as a few rows of each task, not of each batch.

Defined results: null texts stay null and empty ones empty; rows without a key are left as they are and serve as no
source; rows equal in key and text are treated alike, none removes the other's text; rows with one key and different
texts are documents of their own, in the order of their texts' hashes, and none loses what is only the other's; keys
are of any type that has an order; texts of any length are treated whole; an empty table gives an empty table; extra
columns are carried along, a column named ``removed`` is replaced, and ``n_chars`` is counted again if it is a number.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegralType, LongType, StructField, StructType

from tessera.llm.common import arrow_map, alnum_words, chunks

MIN_WORDS, TINY, LONG_UNIT, CUT_EVERY = 12, 3, 40, 8
#: Of short units that are merged: the neighbours a cut is chosen among, and the most of one merged unit.
REACH, MOST = 3, 12
#: Digests (40 bytes each) whose least occurrence a task remembers between batches; integer keys only.
RECENT = 1 << 18
#: Names beside columns that are carried along.
TEXT, HASH, UNITS = "__tessera_text", "__tessera_hash", "__tessera_units"
_EDGE = re.compile(r"\n+|(?<=[.!?…])[^\S\n]+|(?<=[^\s.!?…])[^\S\n]+(?=[A-ZÀ-ÖØ-Þ][^\sA-ZÀ-ÖØ-Þ])|(?<=[。！？])(?![。！？\s])")
_SPACE = re.compile(r"\s+")
#: Letters (with their signs) of Thai, Lao, Tibetan, Burmese, Khmer, Japanese and Chinese; and the signs of the last two.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_SIGNS = re.compile("[\u3000-\u303f\uff00-\uff0f\uff1a-\uff20]")
_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])


def units(text: str) -> list[tuple[int, bytes, int]]:
    """(start, normalised unit, words) in order; a unit reaches up to the next one's start."""
    out, at, short = [], 0, []
    unspaced = _UNSPACED.search(text) is not None
    ends = [m.end() for m in _EDGE.finditer(text)]
    for end in (*ends, len(text)):
        if end <= at:
            continue
        words = alnum_words(text[at:end].encode())
        n = _count(text[at:end]) if unspaced else len(words)
        if n < TINY:
            short.append((at, b" ".join(words), n))
            at = end
            continue
        if short:
            out += _merged(short)
            short = []
        if len(words) <= LONG_UNIT:
            out.append((at, b" ".join(words), n))
        else:
            start, piece = at, text[at:end]
            for m in _SPACE.finditer(piece):
                a = at + m.end()
                last = alnum_words(text[start : a].encode())
                if last and zlib.crc32(last[-1]) % CUT_EVERY == 0 or len(last) > LONG_UNIT * CUT_EVERY:
                    out.append((start, b" ".join(last), _count(text[start:a]) if unspaced else len(last)))
                    start = a
            if start < end:
                words = alnum_words(text[start:end].encode())
                out.append((start, b" ".join(words), _count(text[start:end]) if unspaced else len(words)))
        at = end
    return out + _merged(short)


def _count(piece: str) -> int:
    """Words; two letters of a script without blanks are one."""
    letters, piece = len(_UNSPACED.findall(piece)), _SIGNS.sub(" ", _UNSPACED.sub(" ", piece))
    return len(alnum_words(piece.encode())) + (letters + 1) // 2


def _merged(short: list[tuple[int, bytes, int]]) -> list[tuple[int, bytes, int]]:
    """Short units that follow each other, as units of TINY words or more; fewer words than that stay as they are."""
    filled = [i for i, u in enumerate(short) if u[2]]
    if sum(u[2] for u in short) < TINY:
        return short
    sums, least = [zlib.crc32(short[i][1]) for i in filled], max(REACH, TINY - 1) + 1
    starts = [0]
    for j in range(least, len(filled) - least + 1):  # between filled[j - 1] and filled[j]
        x, left, right = sums[j - 1], sums[j - 1 - REACH : j - 1], sums[j : j + REACH]
        if x < min(left) and x <= min(right) or j - starts[-1] >= MOST:
            starts.append(j)
    edges = [0, *(filled[j] for j in starts[1:]), len(short)]
    return [(short[a][0], b" ".join(u[1] for u in short[a:b] if u[1]), sum(u[2] for u in short[a:b])) for a, b in zip(edges, edges[1:], strict=False)]


class _Recent:
    """Of some digests the least occurrence (key, text hash, unit) that this task has sent, one a slot."""

    def __init__(self):
        self.slots = np.zeros((5, RECENT), np.int64)
        self.used = np.zeros(RECENT, bool)

    def later(self, d: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of these occurrences (one a digest) come after one sent before; the others are remembered."""
        slot = d[:, 0] & (RECENT - 1)
        old = self.slots[:, slot]
        same = self.used[slot] & (old[0] == d[:, 0]) & (old[1] == d[:, 1])
        k, t, u = old[2:]
        after = same & ((k < place[0]) | (k == place[0]) & ((t < place[1]) | (t == place[1]) & (u < place[2])))
        new = ~after
        self.slots[:, slot[new]] = np.concatenate((d[new].T, place[:, new]))
        self.used[slot[new]] = True
        return after


def _digests(batches):
    """From rows (key, text, hash): (h1, h2, k, t, unit, known) of the units that others may repeat."""
    recent = _Recent()
    for b in chunks(batches, TEXT, 1 << 20):
        rows, at, raw = [], [], []
        for row, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(TEXT).to_pylist(), strict=True)):
            if k is None or not t:
                continue
            for i, (_, unit, n) in enumerate(units(t)):
                if n >= TINY:
                    rows.append(row)
                    at.append(i)
                    raw.append(xxhash.xxh3_128_digest(unit))
        if not raw:
            continue
        d, rows, at = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2), np.array(rows), np.array(at, np.int64)
        integral = pa.types.is_integer(b.column(0).type)
        keys = b.column(0).fill_null(0).to_numpy().astype(np.int64) if integral else np.unique(b.column(0).fill_null(min(x for x in b.column(0).to_pylist() if x is not None)).to_pylist(), return_inverse=True)[1]
        place = np.stack((keys[rows], b.column(HASH).to_numpy()[rows], at))
        order = np.lexsort((*place[::-1], d[:, 1], d[:, 0]))
        d, rows, place = d[order], rows[order], place[:, order]
        fresh = np.concatenate(([True], (d[1:] != d[:-1]).any(axis=1)))
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(d)), 0))
        known = (place != place[:, lead]).any(axis=0)  # a lower occurrence stands in this very batch
        again = ~known & ~fresh  # a row repeated as a whole
        if integral:
            after = recent.later(d[fresh], place[:, fresh])
            known |= after[np.cumsum(fresh) - 1]
        d = d.copy()
        d[known, 0] = order[known]  # resolved rows spread over the tasks instead of meeting their group
        send = np.flatnonzero(~again)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d[send, 0]), pa.array(d[send, 1]), b.column(0).take(pa.array(rows[send])), pa.array(place[1, send]), pa.array(place[2, send]), pa.array(known[send])], ["h1", "h2", "k", "t", "unit", "known"]
        )


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, t, units array<bigint>): by key and hash of the text the numbers of the units that repeat an earlier occurrence."""
    rows = docs.select(F.col(key), F.col(text).alias(TEXT), F.xxhash64(text).alias(HASH))
    sent = arrow_map(rows, _digests, StructType([StructField(n, LongType()) for n in ("h1", "h2")] + [StructField("k", docs.schema[key].dataType)] + [StructField(n, LongType()) for n in ("t", "unit")] + [StructField("known", BooleanType())]))
    w = Window.partitionBy("h1", "h2").orderBy("known", "k", "t", "unit")
    marked = sent.withColumn("r", F.rank().over(w)).where(F.col("known") | (F.col("r") > 1))
    return marked.groupBy("k", "t").agg(F.sort_array(F.collect_set("unit")).alias("units"))


def removal(text: str, marked: list[int]) -> list[tuple[int, int]]:
    """Spans of runs of marked units with MIN_WORDS words or more."""
    found, spans = units(text), []
    hit = set(marked)
    ends = [*(u[0] for u in found[1:]), len(text)]
    i = 0
    while i < len(found):
        if i not in hit:
            i += 1
            continue
        last, words, j = i, 0, i
        while j < len(found) and (j in hit or found[j][2] < TINY):
            if j in hit:
                last = j
            j += 1
        words = sum(u[2] for u in found[i : last + 1])
        if words >= MIN_WORDS:
            spans.append((found[i][0], ends[last]))
        i = last + 1
    return spans


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` (``n_chars``, if there, counted again for changed rows),
    and ``removed`` array<struct<start,end>> in characters of the original text."""
    base = docs.drop("removed")
    marked = repeated_units(base, key, text).select(F.col("k").alias(f"{HASH}_k"), F.col("t").alias(HASH), F.col("units").alias(UNITS))
    joined = base.withColumn(f"{HASH}_t", F.xxhash64(text)).join(marked, (F.col(key) == F.col(f"{HASH}_k")) & (F.col(f"{HASH}_t") == F.col(HASH)), "left").drop(HASH, f"{HASH}_k", f"{HASH}_t")
    schema = StructType([*base.schema.fields, StructField("removed", ArrayType(_SPAN))])
    names, counted = base.columns, "n_chars" in base.columns and text != "n_chars" and isinstance(base.schema["n_chars"].dataType, IntegralType)

    def run(batches):
        for b in chunks(batches, text, 1 << 20):
            texts, spans, size = b.column(text).to_pylist(), [], b.column("n_chars").to_pylist() if counted else []
            for i, m in enumerate(b.column(UNITS).to_pylist()):
                cut = removal(texts[i], m) if m and texts[i] else []
                spans.append([{"start": s, "end": e} for s, e in cut])
                if cut:
                    at, kept = 0, []
                    for s, e in cut:
                        kept.append(texts[i][at:s])
                        at = e
                    texts[i] = "".join([*kept, texts[i][at:]])
                    if counted:
                        size[i] = len(texts[i])
            new = {text: pa.array(texts, pa.string())} | ({"n_chars": pa.array(size, b.column("n_chars").type)} if counted else {})
            yield pa.RecordBatch.from_arrays(
                [*(new.get(n, b.column(n)) for n in names), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*names, "removed"]
            )

    return arrow_map(joined, run, schema)
