"""Log probability of texts under a Brown class-based bigram model.

Method: P(word | word before) = P(class | class before) * P(word | class). Exchange clustering assigns words to classes:
a word moves to the class where the bigram likelihood of the classes grows most, its own counts taken out. Every word
that stands MIN_COUNT times or more in the training texts is a unit of its own, up to CLUSTERED of them; rarer and
unknown words are in one of SUFFIXES units by their last three bytes, which are exchanged like words. The HEAD most
frequent words are exchanged one after the other on the driver; all units then in sweeps over the table of their
neighbours, which is dealt out by unit: a sweep moves every second unit, each judged by the class table before it.
There are as many classes as the number of units calls for, up to CLASSES. All counts come from all training tokens.
Emission of a word in its class is additively smoothed (DELTA), each class with one place for unknown words;
transitions are smoothed with the classes' own frequencies. The end of a text is a class of its own, which also stands
before the first word.

What stays on one machine is bounded: DICTIONARY words (some 25 MB a worker) and classes squared. Neighbour counts are
sent as sorted arrays, merged in PARTS parts of the units (each at most its units times all units). Words beyond the
dictionary meet their counts by a shuffle of the distinct rare words of each text.

Defined results: null and empty texts are one end token; a null key is held out; texts of any length are scored whole;
rows that repeat a key are scored each; without training texts every token has probability 1 in the base; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import arrow_map, chunks, fold_bucket, least_count, space_words, utf8
from tessera.storage import materialize, scratch

DICTIONARY, CLUSTERED, MIN_COUNT, SUFFIXES = 150_000, 24_000, 20, 512
CLASSES, HEAD, HEAD_SWEEPS, SWEEPS = 64, 600, 6, 6
DELTA, TRANSITION = 0.1, 1.0
#: Distinct words that a task counts before it sends them on; tokens whose pairs it counts before it sends them on.
COUNTED, PAIRED = 400_000, 2_000_000
#: Parts of the units that the neighbours are dealt into.
PARTS = 512
#: Units judged together: so many tables of classes squared are held.
TOGETHER = 96


class Units:
    """Dictionary numbers (-1: not in it) and units of a text's words: the first ``clustered`` words are units of their
    own, the others fall into SUFFIXES units; the last unit is the end of a text."""

    def __init__(self, words: list[bytes], clustered: int):
        self.words, self.end = clustered, clustered + SUFFIXES
        self.number = {w: i for i, w in enumerate(words)}
        self.unit = np.array([i if i < clustered else self.suffix(w) for i, w in enumerate(words)] + [self.end], np.int32)

    def suffix(self, word: bytes) -> int:
        return self.words + zlib.crc32(word[-3:]) % SUFFIXES

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(at < 0)
        unit = self.unit[at]
        if len(rare):
            unit[rare] = [self.suffix(words[i]) for i in rare.tolist()]
        return at, unit, rare


def word_counts(source: DataFrame) -> DataFrame:
    """(w binary, n): how often each word stands in ``_text``."""

    def run(batches):
        counts: Counter[bytes] = Counter()
        for b in chunks(batches, "_text", 8 << 20):
            for t in b.column("_text").to_pylist():
                counts.update(space_words(t))
                if len(counts) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])
                    counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

    return arrow_map(source, run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


_SENT = "part int, keys binary, n binary"


def _sent(part: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["part", "keys", "n"])


#: The arrays of a part: its units (int32), where the neighbours of each end (int64), the neighbours (int32), their counts (int64).
_PART = ("units", "ends", "others", "n")


def _arrays(batch: pa.RecordBatch):
    """The arrays of each part of a batch, as views of its buffers."""
    for k in range(batch.num_rows):
        yield tuple(np.frombuffer(batch.column(x)[k].as_buffer(), kind) for x, kind in zip(_PART, (np.int32, np.int64, np.int32, np.int64), strict=True))


def neighbours(source: DataFrame, shared, size: int) -> DataFrame:
    """(part, units, ends, others, n): of the units of a part, one after the other, how often each other unit follows (as
    2 * other) or goes before (as 2 * other + 1), over all texts; one row a part."""

    def count(batches):
        words, clustered = shared.value
        units = Units(words, clustered)
        end = np.array([units.end], np.int64)
        seen, held = [end], 1

        def flush():
            row = np.concatenate(seen)
            pair, n = np.unique(row[:-1] * size + row[1:], return_counts=True)
            before, after = pair // size, pair % size
            keys = np.concatenate((2 * pair, 2 * (after * size + before) + 1))
            n = np.concatenate((n, n)).astype(np.int64)
            part = np.concatenate((before, after)) % PARTS
            order = np.lexsort((keys, part))
            keys, n, part = keys[order], n[order], part[order]
            cut = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
                if a < b:
                    yield _sent(int(part[a]), keys[a:b], n[a:b])

        for b in chunks(batches, "_text", 8 << 20):
            for t in b.column("_text").to_pylist():
                seen += (units(space_words(t))[1], end)
                held += len(seen[-2]) + 1
                if held > PAIRED:
                    yield from flush()
                    seen, held = [end], 1
        if held > 1:
            yield from flush()

    def merge(batches):
        part, keys, n, held = None, [], [], 0
        for b in batches:
            for p, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if part is not None and p != part or held > 4 * PAIRED:
                    both = _summed(np.concatenate(keys), np.concatenate(n))
                    if p != part:
                        yield merged(part, *both)
                        keys, n, held = [], [], 0
                    else:
                        keys, n, held = [both[0]], [both[1]], 0
                part = p
                keys.append(np.frombuffer(k, np.int64))
                n.append(np.frombuffer(c, np.int64))
                held += len(keys[-1])
        if part is not None:
            yield merged(part, *_summed(np.concatenate(keys), np.concatenate(n)))

    def merged(part, keys, n):
        unit, other = np.divmod(keys >> 1, size)
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        columns = unit[first].astype(np.int32), np.append(first[1:], len(unit)), (2 * other + (keys & 1)).astype(np.int32), n
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["part", *_PART])

    sent = arrow_map(source, count, _SENT)
    return arrow_map(sent.repartition("part").sortWithinPartitions("part"), merge, "part int, " + ", ".join(f"{x} binary" for x in _PART))


def _by_class(arrays, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a part: its units, and for each how often it is followed by and follows each class (units x k), and itself.
    Neighbours without a class (-1) are left out."""
    units, ends, others, n = arrays
    at = np.repeat(np.arange(len(units)), np.diff(ends, prepend=0))
    other, c = others >> 1, group[others >> 1]
    place = (2 * at + (others & 1)) * k + c
    known = c >= 0
    if not known.all():
        place, counted = place[known], n[known]
    else:
        counted = n
    counts = np.bincount(place, counted, len(units) * 2 * k).reshape(-1, 2, k)
    self_pairs = np.flatnonzero((units[at] == other) & (others & 1 == 0))
    own = np.zeros(len(units))
    own[at[self_pairs]] = n[self_pairs]
    return units, counts[:, 0], counts[:, 1], own


def class_pairs(table: DataFrame, group: np.ndarray, k: int) -> np.ndarray:
    """How often each class follows each (k x k)."""
    shared = table.sparkSession.sparkContext.broadcast(group)

    def run(batches):
        group, total = shared.value, np.zeros((k, k))
        for b in batches:
            for arrays in _arrays(b):
                units, right, _, _ = _by_class(arrays, group, k)
                known = group[units] >= 0
                np.add.at(total, group[units[known]], right[known])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

    rows = arrow_map(table, run, "t binary").collect()
    shared.destroy()
    return sum((np.frombuffer(bytes(r[0])).reshape(k, k) for r in rows), np.zeros((k, k)))


def _grown(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    """(x + more) log(x + more) - x log x, without losing small growth of large numbers."""
    x = np.maximum(x, 1e-6)
    return more * np.log(x + more + 1e-30) + x * np.log1p(more / x)


def best_classes(table: np.ndarray, group: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For units of these classes (-1: none yet), and their counts by class, the class where the likelihood is highest.
    The last class is the end's alone."""
    k = len(table)
    out = np.empty(len(group), np.int64)
    for a in range(0, len(group), TOGETHER):
        g, r, l, o = (x[a : a + TOGETHER] for x in (group, right.astype(np.float32), left.astype(np.float32), own.astype(np.float32)))
        rows = np.arange(len(g))
        t = np.repeat(table[None].astype(np.float32), len(g), axis=0)
        r, l, in_class = r.copy(), l.copy(), np.flatnonzero(g >= 0)
        c = g[in_class]
        r[in_class, c] -= o[in_class]  # pairs of the unit with itself move with it
        l[in_class, c] -= o[in_class]
        t[in_class, c, :] -= r[in_class]
        t[in_class, :, c] -= l[in_class]
        t[in_class, c, c] -= o[in_class]
        np.maximum(t, 0, out=t)
        diagonal = t[:, np.arange(k), np.arange(k)]
        both, n, m = r + l + o[:, None], r.sum(1) + o, l.sum(1) + o
        gain = _grown(t, r[:, None, :]).sum(2) + _grown(t, l[:, :, None]).sum(1)
        gain += _grown(diagonal, both) - _grown(diagonal, r) - _grown(diagonal, l)
        gain -= _grown(t.sum(2) + l, n[:, None]) + _grown(t.sum(1) + r, m[:, None])  # the other classes' totals keep their pairs with the unit
        best = np.argmax(gain[:, : k - 1], axis=1)
        stay = (g >= 0) & (gain[rows, best] <= gain[rows, np.maximum(g, 0)] * (1 + 1e-6) + 1e-4)
        out[a : a + TOGETHER] = np.where(stay, g, best)
    return out


def cluster(table: DataFrame, units: int, head: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit (the end's is the last one, ``k - 1``) and how often each class follows each."""
    sc = table.sparkSession.sparkContext

    def of_head(batches):
        for b in batches:
            for own, ends, others, n in _arrays(b):
                a, z = np.repeat(own, np.diff(ends, prepend=0)), others >> 1
                some = ((a < head) | (a == units - 1)) & ((z < head) | (z == units - 1)) & (others & 1 == 0)
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in (np.minimum(a, head), np.minimum(z, head), n)], ["a", "b", "n"])

    pairs = np.zeros((head + 1, head + 1))
    few = arrow_map(table, of_head, "a long, b long, n long").toArrow()
    pairs[few.column(0).to_numpy(), few.column(1).to_numpy()] = few.column(2).to_numpy()
    group = np.full(units, -1, np.int64)
    group[np.append(np.arange(head), units - 1)] = exchange(pairs, k - 1, HEAD_SWEEPS)
    total = class_pairs(table, group, k)
    for sweep in range(SWEEPS):
        shared = sc.broadcast((group, total))

        def run(batches, sweep=sweep, shared=shared):
            group, total = shared.value
            for b in batches:
                for arrays in _arrays(b):
                    some, right, left, own = _by_class(arrays, group, k)
                    move = np.flatnonzero((some < units - 1) & ((group[some] < 0) if sweep == 0 else (some // PARTS) % 2 == sweep % 2))
                    if len(move):
                        new = best_classes(total, group[some[move]], right[move], left[move], own[move])
                        yield pa.RecordBatch.from_arrays([pa.array(some[move].astype(np.int64)), pa.array(new)], ["unit", "class"])

        moved = arrow_map(table, run, "unit long, class long").toArrow()
        shared.destroy()
        at, new = moved.column(0).to_numpy(), moved.column(1).to_numpy()
        changed = int((group[at] != new).sum())
        group[at] = new
        if sweep == 0:
            group[group < 0] = 0  # units without any count
        total = class_pairs(table, group, k)
        if sweep > 1 and changed < 0.005 * max(1, len(at)):
            break
    return group, total


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of each unit, one unit after the other; the last unit, the end, keeps the last class (``classes``) for
    itself. The most frequent units start a class each, the others are put where the likelihood grows most, and then all
    are taken out and put anew, ``sweeps`` times or until none moves."""
    k, units = classes + 1, len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight[: units - 1], kind="stable")
    group = np.full(units, -1, np.int64)
    group[-1] = classes
    right, left = np.zeros((units, k)), np.zeros((units, k))  # of each unit: by class of the next and of the one before
    right[:, classes], left[:, classes] = pairs[:, -1], pairs[-1, :]
    table = np.zeros((k, k))
    table[classes, classes] = pairs[-1, -1]

    def take(u: int, b: int, sign: int) -> None:
        right[:, b] += sign * pairs[:, u]
        left[:, b] += sign * pairs[u, :]

    for sweep in range(sweeps + 1):
        moved = 0
        for place, u in enumerate(order):
            a, own = int(group[u]), pairs[u, u]
            r, l = right[u].copy(), left[u].copy()
            if a >= 0:
                r[a] -= own
                l[a] -= own
                table[a, :] -= r
                table[:, a] -= l
                table[a, a] -= own
            rows, cols, n, m = table.sum(1) + l, table.sum(0) + r, r.sum() + own, l.sum() + own
            gain = (_x_log_x(table + r) - _x_log_x(table)).sum(1) + (_x_log_x(table + l[:, None]) - _x_log_x(table)).sum(0)
            d = np.diagonal(table)
            gain += _x_log_x(d + r + l + own) + _x_log_x(d) - _x_log_x(d + r) - _x_log_x(d + l)
            gain -= _x_log_x(rows + n) - _x_log_x(rows) + _x_log_x(cols + m) - _x_log_x(cols)
            b = place if sweep == 0 and place < classes else int(np.argmax(gain[:classes]))
            if a >= 0 and gain[b] <= gain[a] + 1e-9:
                b = a
            table[b, :] += r
            table[:, b] += l
            table[b, b] += own
            if b != a:
                moved += 1
                group[u] = b
                if a >= 0:
                    take(u, a, -1)
                take(u, b, 1)
        if not moved:
            break
    return group


@dataclass
class Model:
    words: list[bytes]
    clustered: int  # so many of them are units of their own
    log_count: np.ndarray  # log10(count + DELTA) of the dictionary's words; last of an unknown word
    group: np.ndarray  # by unit
    step: np.ndarray  # log10 P(class | class before); the last class is the end's
    below: np.ndarray  # log10 of a class's smoothed total
    tokens: int
    ends: int
    base_below: float


def train(source: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts in ``_text``, and the table of all word counts."""
    sc = source.sparkSession.sparkContext
    counts = materialize(word_counts(source), "counts")
    top = counts.where(F.col("n") >= least_count(counts, DICTIONARY)).toArrow()
    ranked = sorted(zip(top.column(1).to_pylist(), top.column(0).to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    words, often = [w for _, w in ranked], np.array([n for n, _ in ranked], np.float64)
    clustered = min(CLUSTERED, int(np.searchsorted(-often, -MIN_COUNT, side="right")))
    units = clustered + SUFFIXES + 1
    k = min(CLASSES, max(2, math.isqrt(units) // 2)) + 1
    ends = source.count()
    table = materialize(neighbours(source, sc.broadcast((words, clustered)), units), "neighbours")
    group, pairs = cluster(table, units, min(HEAD, clustered), k)
    total, distinct = _by_unit(counts, words, clustered)
    class_total, class_words = np.bincount(group, total, k), np.bincount(group, distinct, k)
    class_total[k - 1], tokens = ends, int(total.sum()) + ends
    share = (class_total + 0.5) / (class_total.sum() + 0.5 * k)
    step = (pairs + TRANSITION * share) / (pairs.sum(1, keepdims=True) + TRANSITION)
    base = tokens + 0.1 * (int(distinct.sum()) + bool(ends) + 1)
    return Model(words, clustered, np.log10(np.append(often, 0) + DELTA), group, np.log10(step), np.log10(class_total + DELTA * (class_words + 1)), tokens, ends, math.log10(base)), counts


def _by_unit(counts: DataFrame, words: list[bytes], clustered: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each unit."""
    shared = counts.sparkSession.sparkContext.broadcast(words[:clustered])
    size = clustered + SUFFIXES + 1

    def run(batches):
        units, n, d = Units(shared.value, clustered), np.zeros(size), np.zeros(size)
        for b in batches:
            unit = units(b.column(0).to_pylist())[1]
            n += np.bincount(unit, b.column(1).to_numpy(), size)
            d += np.bincount(unit, minlength=size)
        at = np.flatnonzero(d)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at].astype(np.int64)), pa.array(d[at].astype(np.int64))], ["unit", "n", "d"])

    total, distinct = np.zeros(size), np.zeros(size)
    for u, n, d in arrow_map(counts, run, "unit long, n long, d long").groupBy("unit").agg(F.sum("n"), F.sum("d")).collect():
        total[u], distinct[u] = n, d
    return total, distinct


def score(source: DataFrame, model: Model, counts: DataFrame, key: str) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of the rows (key, held_out, _text)."""
    shared = source.sparkSession.sparkContext.broadcast(model)
    kind = source.schema[key].dataType.simpleString()

    def run(batches):
        m = shared.value
        units, end = Units(m.words, m.clustered), len(m.step) - 1
        for b in chunks(batches, "_text", 8 << 20):
            tokens, known, logs, path, rare_words, rare_n, ends = [], [], [], [], [], [], [0]
            for t in b.column("_text").to_pylist():
                words = space_words(t)
                at, unit, rare = units(words)
                group = np.append(m.group[unit], end)
                path.append(float(m.step[np.concatenate(([end], group[:-1])), group].sum() - m.below[group[:-1]].sum()))
                logs.append(float(m.log_count[at].sum()))
                tokens.append(len(words) + 1)
                known.append(len(words) - len(rare) + (m.ends > 0))
                few = Counter([words[i] for i in rare.tolist()])
                rare_words += few
                rare_n += few.values()
                ends.append(len(rare_words))
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_n, pa.int32())], ["w", "f"])
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(path, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                [key, "held_out", "n_tokens", "n_known", "logs", "path", "rare"],
            )

    local = arrow_map(source, run, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, logs double, path double, rare array<struct<w:binary,f:int>>")
    local = materialize(local.withColumn("row", F.monotonically_increasing_id()), "local")
    rare = local.select("row", F.explode("rare").alias("r")).select("row", "r.w", "r.f")
    met = rare.join(counts, "w").groupBy("row").agg(F.sum("f").alias("more"), F.sum(F.col("f") * (F.log10(F.col("n") + F.lit(DELTA)) - math.log10(DELTA))).alias("gain"))
    out = local.drop("rare").join(met, "row", "left")
    logs = F.col("logs") + F.coalesce("gain", F.lit(0.0))
    return out.select(
        key, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs + math.log10(model.ends + 0.1) - F.col("n_tokens") * F.lit(model.base_below)).alias("base_score"), (logs + F.col("path")).alias("score"),
    )


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    out = F.coalesce(fold_bucket(F.col(key), folds) == 0, F.lit(True))
    source = docs.select(F.col(key), out.alias("held_out"), utf8(text).alias("_text"))
    with scratch(docs.sparkSession):
        model, counts = train(source.where(~F.col("held_out")).select("_text"))
        return materialize(score(source, model, counts, key), "scores", keep=True)
