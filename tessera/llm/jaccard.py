"""Similarity join of texts on their sets of word shingles, and the groups that its links form.

Method: a text's set is its distinct five-word shingles. Equal sets form a class with one representative. The shingles
of a set are hashed into GROUPS groups, and the group counts are the set's point. No overlap of two sets exceeds the sum
over the groups of the smaller count, nor that of the upper corners of two boxes of points. All candidate pairs come
from R-trees over points, at every size: a tree is packed over the rows of many cells (first coordinate the cell, then
the set's size), and joined with itself from its root down, leaving out pairs of boxes that share no cell, whose sizes
or whose bound exclude a link, or that are known to be connected. Surviving pairs are verified on the texts' whole sets.

A tree over all points would compare each with each in 256 dimensions, so a guard deals the points into cells: sets that
can be linked share a shingle among the first quarter of either in one global order of all shingles. A cell holds the
sets that share one; of a shingle that over BUCKET sets share, each cell holds a block of them. The order puts shingles
that very many texts share last, so that common passages do not fill cells; it is counted over all texts, and any order
gives the same links.

Links are found in two steps, so that a large group does not cost all its pairs. First each set is put into the cells of
its PICKS first shared shingles only, and of what the trees find its TRIED likeliest partners in a cell are verified;
that connects most of each group. Then the cells that still hold several components are searched whole: the sets
outside a cell's largest component against all others. Of the pairs found, one for each set and component is verified
first, and at last all whose ends are still apart. No pair is left out unless its ends are already connected, so the
groups are exact.

Defined results: null and empty texts have an empty set and are linked with nothing; with fewer than five words the
whole sequence is the one shingle; texts of any length are taken whole; rows without a key have no links and a null
group; rows that repeat a key are one document, linked by any of their texts; keys are integers (others raise); an empty
table gives an empty table; extra columns are not read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.common import FOLD, arrow_map, chunks, least_count, utf8
from tessera.operators.graph import linked
from tessera.storage import broadcast_if_small, materialize, scratch

WORDS, SIMILARITY = 5, Fraction(3, 4)
#: Groups of the counts; a count stops at 255, and where it did the bound is not used.
GROUPS = 256
#: A shingle that COMMON texts share goes to the end of the order; the COMMON_MOST most frequent ones at most (8 bytes
#: each are broadcast). How they are found: see ``_common``.
COMMON, COMMON_MOST, COMMON_SHARE, SPARSE, REACH = 32, 500_000, 0.002, 16, 24
#: Groups of the finer counts that are compared before texts are.
FINE = 1024
#: Rows of a block of a large bucket; entries of a leaf and of an inner node.
BUCKET, LEAF = 2048, 16
#: Cells that a set is put into in the first step, partners verified of each, and sets that all blocks of a bucket hold.
PICKS, TRIED, PIVOTS = 3, 2, 4
#: So many bucket shingles of a set travel with its point: a pair that shares one is looked at in that one's bucket only.
FIRST = 6
TEXT = "__tessera_text"
#: Ids (8 to 16 bytes each) that may be broadcast; beyond it the join shuffles.
BROADCAST_IDS = 300_000

#: Bytes hashed at once: memory is some 40 times this, whatever a text's length.
SEGMENT = 1 << 20
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n + 1`` of each."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word in order: a difference of prefix sums over the bytes, made free of its place."""
    if len(text) > SEGMENT:
        out, at = [], 0
        while at < len(text):
            end = at + SEGMENT
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            out.append(word_hashes(text[at:end]) if end - at <= SEGMENT else _hashes(text[at:end]))
            at = end
        return np.concatenate(out)
    return _hashes(text)


def _hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text.translate(FOLD), np.uint8)
    space = np.ones(len(b) + 2, np.int8)
    space[1:-1] = _SPACE[b]
    edge = np.flatnonzero(np.diff(space))
    first, last = edge[::2], edge[1::2]
    power, inverse = _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LETTER[b] * power[: len(b)], out=sums[1:])
    return _mix((sums[last] - sums[first]) * inverse[first])


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """A hash of each run of ``width`` words in order; of the whole sequence if it is shorter."""
    h = word_hashes(text)
    if not len(h):
        return np.empty(0, np.int64)
    size = min(width, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * _STEP
        out ^= out >> np.uint64(29)
    return _mix(out).view(np.int64)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingles(text))


def _tally(flat: np.ndarray) -> pa.RecordBatch:
    found, n = np.unique(flat, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["s", "n"])


def _frequent(counted: DataFrame) -> np.ndarray:
    """Of (s, n) rows the shingles that sum to COMMON or more, the most frequent COMMON_MOST at most, sorted."""
    total = materialize(counted.groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON), "frequent")
    return np.sort(total.where(F.col("n") >= least_count(total, COMMON_MOST)).select("s").toArrow().column(0).to_numpy().astype(np.int64))


def _common(source: DataFrame) -> np.ndarray:
    """The shingles that stand last in the order, sorted.

    First all texts are counted for one shingle in SPARSE, chosen by its hash, and for those frequent inside a batch.
    A passage that many texts share shows by some of its shingles; then the shingles within REACH of these are counted.
    """

    def count(batches):
        for b in chunks(batches, TEXT, 3 << 20):
            every = [shingles(t) for t in b.column(TEXT).to_pylist()]
            if every:
                flat = np.concatenate(every)
                slot = flat & 0xFFFFF
                often = np.bincount(slot, minlength=1 << 20)[slot] >= max(3, COMMON_SHARE * len(every))
                yield _tally(flat[often | (flat & (SPARSE - 1) == 0)])

    seeds = _frequent(arrow_map(source, count, "s long, n long"))
    if not len(seeds):
        return seeds
    shared = source.sparkSession.sparkContext.broadcast(seeds)

    def spread(batches):
        seeds = shared.value
        for b in chunks(batches, TEXT, 3 << 20):
            near = []
            for t in b.column(TEXT).to_pylist():
                s = shingles(t)
                hit = np.flatnonzero(seeds[np.minimum(np.searchsorted(seeds, s), len(seeds) - 1)] == s)
                if len(hit):
                    edge = np.zeros(len(s) + 1, np.int64)
                    np.add.at(edge, np.maximum(hit - REACH, 0), 1)
                    np.add.at(edge, np.minimum(hit + REACH + 1, len(s)), -1)
                    near.append(np.unique(s[np.cumsum(edge[:-1]) > 0]))
            if near:
                yield _tally(np.concatenate(near))

    return _frequent(arrow_map(source, spread, "s long, n long"))


def _counts(s: np.ndarray, groups: int = GROUPS) -> bytes:
    return np.minimum(np.bincount(s & (groups - 1), minlength=groups), 255).astype(np.uint8).tobytes()


def _points(source: DataFrame, common: np.ndarray) -> DataFrame:
    """(id, n, h1, h2, point, fine, prefix) of each row: size and digest of the set, group counts, first shingles in the order."""
    shared = source.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        last = shared.value
        for b in chunks(batches, TEXT, 3 << 20):
            size, digest, points, fine, first, ends = [], [], [], [], [], [0]
            for t in b.column(TEXT).to_pylist():
                s = shingle_set(t)
                n = len(s)
                size.append(n)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                points.append(_counts(s))
                fine.append(_counts(s, FINE))
                if n:
                    take = n - int(-(-SIMILARITY * n // 1)) + 1
                    if len(last):
                        at = np.searchsorted(last, s)
                        late = last[np.minimum(at, len(last) - 1)] == s
                        s = np.concatenate((s[~late], s[late]))
                    first.append(s[:take])
                    ends.append(ends[-1] + take)
                else:
                    ends.append(ends[-1])
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            flat = np.concatenate(first) if first else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["id", "n", "h1", "h2", "point", "fine", "prefix"],
            )

    return arrow_map(source, run, "id long, n long, h1 long, h2 long, point binary, fine binary, prefix array<long>")


def _and_end(batches):
    yield from batches
    yield None


class RTree:
    """Points packed into leaves of LEAF in the order given, by cell and size, and leaves into boxes of LEAF. A box keeps
    its first and last cell, least and greatest size, the component if all share one (else -1), and its upper corner."""

    def __init__(self, cell: np.ndarray, size: np.ndarray, group: np.ndarray, points: np.ndarray):
        self.levels, self.full = [(cell, cell, size, size, group, points)], bool(len(points)) and int(points.max()) == 255
        while len(self.levels[-1][0]) > LEAF:
            low, high, least, most, own, top = self.levels[-1]
            cut = np.arange(0, len(low), LEAF)
            lowest, highest = np.minimum.reduceat(own, cut), np.maximum.reduceat(own, cut)
            last = np.append(cut[1:], len(low)) - 1
            self.levels.append((low[cut], high[last], np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.where(lowest == highest, lowest, -1), np.maximum.reduceat(top, cut)))

    def _near(self, level: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs p <= q of boxes (or points) those that may hold a pair to find."""
        low, high, least, most, own, top = self.levels[level]
        keep = (low[q] <= high[p]) & (4 * most[p] >= 3 * least[q]) & (4 * most[q] >= 3 * least[p]) & ((own[p] != own[q]) | (own[p] < 0))
        p, q = p[keep], q[keep]
        if self.full or not len(p):
            return p, q
        good = [7 * np.minimum(top[p[a : a + 8192]], top[q[a : a + 8192]]).sum(axis=1, dtype=np.int64) >= 3 * (least[p[a : a + 8192]] + least[q[a : a + 8192]]) for a in range(0, len(p), 8192)]
        good = np.concatenate(good) | (p == q) & (level > 0)
        return p[good], q[good]

    def pairs(self):
        """The tree joined with itself: arrays p < q of points of one cell and different components that the bounds leave."""
        level = len(self.levels) - 1
        p, q = np.triu_indices(len(self.levels[level][0]), 0 if level else 1)
        yield from self._down(level, p, q)

    def _down(self, level: int, p: np.ndarray, q: np.ndarray):
        p, q = self._near(level, p, q)
        if not level:
            if len(p):
                yield p, q
            return
        n = len(self.levels[level - 1][0])
        i, j = (x.ravel() for x in np.indices((LEAF, LEAF)))
        for a in range(0, len(p), 1024):
            x, y = (p[a : a + 1024, None] * LEAF + i).ravel(), (q[a : a + 1024, None] * LEAF + j).ravel()
            keep = (y < n) & ((x < y) if level == 1 else (x <= y))
            yield from self._down(level - 1, x[keep], y[keep])


def _matrix(column: pa.Array, groups: int = GROUPS) -> np.ndarray:
    """The points of a column as rows of counts."""
    return np.frombuffer(column.buffers()[2], np.uint8)[column.offset * groups : (column.offset + len(column)) * groups].reshape(-1, groups)


def _possible(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether points leave the similarity possible, and the bound of the overlap by the sizes, in thousandths."""
    low = np.minimum(x, y)
    bound = low.sum(axis=1, dtype=np.int64)
    return (7 * bound >= 3 * sizes) | (low == 255).any(axis=1), 1000 * bound // np.maximum(sizes, 1)


def _cells(batches, keys: int, arrays: int):
    """Rows sorted by their first ``keys`` columns, again as whole cells: the integer columns as rows of a matrix, then
    the ``arrays`` that follow (points, and lists of FIRST). A cell that the next batch may go on with is held back."""
    hold = None
    for batch in _and_end(batches):
        now = None
        if batch is not None and batch.num_rows:
            n = batch.num_columns - arrays
            now = [np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n)], axis=1), _matrix(batch.column(n))]
            if arrays > 1:
                now.append(batch.column(n + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FIRST))
        parts = [x for x in (hold, now) if x is not None]
        if not parts:
            continue
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]
        start = np.flatnonzero(np.concatenate(([True], (rows[0][1:, :keys] != rows[0][:-1, :keys]).any(axis=1))))
        end = len(rows[0]) if batch is None else int(start[-1])
        hold = None if batch is None else [x[end:] for x in rows]
        if end:
            cell = np.searchsorted(start, np.arange(end), side="right")
            yield cell, [x[:end] for x in rows]


def _tree(cell: np.ndarray, size: np.ndarray, group: np.ndarray, points: np.ndarray):
    """Candidate pairs of rows that stand in one cell, with the bound of their overlap in thousandths of their sizes."""
    alone = np.concatenate(([True], cell[1:] != cell[:-1], [True]))
    at = np.flatnonzero(~(alone[:-1] & alone[1:]))  # rows that share their cell with others
    if not len(at):
        return
    for p, q in RTree(cell[at], size[at], group[at], points[at]).pairs():
        p, q = at[p], at[q]
        for a in range(0, len(p), 8192):
            x, y = p[a : a + 8192], q[a : a + 8192]
            good, worth = _possible(points[x], points[y], size[x] + size[y])
            yield x[good], y[good], worth[good]


def _first_step(batches):
    """From rows (s, block, n, id, point) sorted by cell and size: for each the TRIED likeliest partners, as (a, b)."""
    for cell, (rows, points) in _cells(batches, 2, 1):
        size, ids = rows[:, 2], rows[:, 3]
        best = np.full((2, TRIED, len(ids)), -1, np.int64)  # worth and partner, the likeliest first
        for p, q, worth in _tree(cell, size, ids, points):
            x, y, worth = np.concatenate((p, q)), np.concatenate((q, p)), np.concatenate((worth, worth))
            order = np.lexsort((ids[y], -worth, x))
            x, y, worth = x[order], y[order], worth[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            for r in range(TRIED):  # the best of these, merged into the best so far
                some = place == r
                a, w, partner = x[some], worth[some], y[some]
                for k in range(TRIED):
                    better = w > best[0, k, a]
                    best[:, k, a], w, partner = np.where(better, (w, partner), best[:, k, a]), np.where(better, best[0, k, a], w), np.where(better, best[1, k, a], partner)
        k, a = np.nonzero(best[1] >= 0)
        if len(a):
            x, y = ids[a], ids[best[1, k, a]]
            pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _second_step(batches):
    """From rows (s, i, j, n, id, component, role, point, first) sorted by cell and size: candidate pairs of different
    components, of which one is asked (role 1 or 3) and one answers (role 2 or 3) in the cell."""
    for cell, (rows, points, first) in _cells(batches, 3, 2):
        s, size, ids, group, role = rows[:, 0], rows[:, 3], rows[:, 4], rows[:, 5], rows[:, 6]
        for p, q, worth in _tree(cell, size, group, points):
            keep = ((role[p] & 1) & (role[q] >> 1) | (role[q] & 1) & (role[p] >> 1)) == 1
            p, q, worth = p[keep], q[keep], worth[keep]
            both = (first[p][:, :, None] == first[q][:, None, :]).any(axis=2)
            here = (~both.any(axis=1) | (first[p, both.argmax(axis=1)] == s[p])) & (ids[p] != ids[q])
            if here.any():
                x, y = ids[p[here]], ids[q[here]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(worth[here])], ["a", "b", "worth"])


def possible(pairs: DataFrame, points: DataFrame, kind: str = "point", groups: int = GROUPS) -> DataFrame:
    """(a, b, worth) of the pairs (a, b) that the points leave possible."""
    side = lambda end: points.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col(kind).alias(f"p{end}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches):
        for b in batches:
            good, worth = _possible(_matrix(b.column(4), groups), _matrix(b.column(5), groups), b.column(2).to_numpy() + b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*(pa.array(b.column(k).to_numpy()[good]) for k in (0, 1)), pa.array(worth[good])], ["a", "b", "worth"])

    return arrow_map(rows, run, "a long, b long, worth long")


def verify(pairs: DataFrame, source: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' whole sets are similar enough; the finer counts rule most others out first."""
    pairs = materialize(possible(pairs, points, "fine", FINE).select("a", "b"), "pairs")

    def having(ids: DataFrame) -> DataFrame:
        """The rows of ``source`` with these ids."""
        return source.where(F.col("id").isNotNull()).join(broadcast_if_small(ids, BROADCAST_IDS), "id", "left_semi")

    first = having(materialize(pairs.select(F.col("a").alias("id")).distinct(), "ids"))
    second = having(materialize(pairs.select(F.col("b").alias("id")).distinct(), "ids"))
    both = broadcast_if_small(pairs, BROADCAST_IDS // 2)
    left = first.select(F.col("id").alias("a"), F.col(TEXT).alias("x")).join(both, "a")
    rows = left.join(second.select(F.col("id").alias("b"), F.col(TEXT).alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        kept = {}
        for batch in chunks(batches, "x", 4 << 20):
            a, b, good = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                if b[i] not in kept:
                    if len(kept) >= 64:
                        kept.clear()
                    kept[b[i]] = shingle_set(y.as_py())
                s, t = shingle_set(x.as_py()), kept[b[i]]
                at = np.minimum(np.searchsorted(t, s), max(0, len(t) - 1))
                shared = int((t[at] == s).sum()) if len(t) and len(s) else 0
                if shared and 100 * shared >= 75 * (len(s) + len(t) - shared):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in good], pa.int64()) for v in (a, b)], ["a", "b"])

    return arrow_map(rows, run, "a long, b long").distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row, as a written table; what was needed for it is deleted."""
    with scratch(docs.sparkSession):
        return materialize(_groups(docs, key, text), "components", keep=True)


def _groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be of an integer type")
    source = docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias(TEXT))
    points = materialize(_points(source, _common(source)), "points")
    full = points.where("n > 0 and id is not null")
    sets = ["n", "h1", "h2"]
    again = full.groupBy(*sets).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = materialize(again, "classes")
    alike = full.join(broadcast_if_small(again, BROADCAST_IDS // 4), sets)
    copies = materialize(alike.where("id <> rep").select("id", "rep").distinct(), "copies")
    wide = ["id", "n", "point"]
    reps = full.join(broadcast_if_small(again, BROADCAST_IDS // 4), sets, "left_anti").select(*wide, "prefix").unionByName(alike.where("id = rep").dropDuplicates(sets).select(*wide, "prefix"))

    # The shingles of the prefixes that several sets share, and of each set the first few.
    entries = reps.select(F.explode("prefix").alias("s"), "id")
    often = entries.groupBy("s").agg(F.count("*").alias("m")).where("m > 1")
    shared = materialize(entries.join(often, "s"), "shared")
    reps = materialize(reps.join(broadcast_if_small(materialize(shared.select("id").distinct(), "ids"), BROADCAST_IDS), "id", "left_semi").select(*wide), "sets")
    picks = shared.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("s", "m"))), 1, PICKS).alias("p")).select("id", F.explode("p").alias("p")).select("id", "p.*")
    picks = materialize(picks.withColumn("blocks", F.ceil(F.col("m") / BUCKET)).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")), "picks")
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id"))["id"] for k in range(PIVOTS)]
    pivots = picks.where("blocks > 1").groupBy("s", "blocks").agg(F.array(*drawn).alias("ids"))
    pivots = pivots.select("s", "blocks", F.explode(F.array_distinct("ids")).alias("id")).select("s", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    cells = picks.select("s", "id", "block").unionByName(pivots).join(reps, "id").repartition("s", "block").sortWithinPartitions("s", "block", "n", "id")
    tried = materialize(arrow_map(cells.select("s", "block", "n", "id", "point"), _first_step, "a long, b long").distinct(), "tried")
    # A document whose texts are in several classes holds these together.
    held = copies.join(shared.select("id").distinct(), "id", "left_semi").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"))
    links = materialize(verify(tried, source, points).unionByName(held), "links")
    known = linked(links)

    # What can still connect two components: of a bucket with several, the sets outside the largest against all.
    rows = shared.join(broadcast_if_small(known, BROADCAST_IDS), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = materialize(rows, "rows")
    parts = rows.groupBy("s", "component").agg(F.count("*").alias("c")).groupBy("s").agg(F.count("*").alias("k"), F.max(F.struct("c", "component")).alias("top"))
    parts = parts.where("k > 1").select("s", F.col("top.component").alias("major"), F.col("top.c").alias("c"))
    mixed = rows.join(parts, "s").withColumn("minor", F.col("component") != F.col("major"))
    mixed = materialize(mixed.withColumn("wide", F.ceil(F.col("m") / BUCKET)).withColumn("deep", F.ceil((F.col("m") - F.col("c")) / BUCKET)).select("s", "id", "component", "minor", "wide", "deep"), "mixed")
    first = mixed.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("s")), 1, FIRST).alias("f"))
    first = first.select("id", F.transform(F.sequence(F.lit(1), F.lit(FIRST)), lambda i: F.coalesce(F.try_element_at("f", i), F.col("f")[0])).alias("first"))
    one = mixed.where("wide = 1 and deep = 1").select("s", "id", "component", *(F.lit(0).cast("long").alias(c) for c in "ij"), F.when(F.col("minor"), 3).otherwise(2).alias("role"))
    many, upto = mixed.where("wide > 1 or deep > 1"), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    answers = many.select("s", "id", "component", upto("deep").alias("i"), F.pmod(F.xxhash64("id"), "wide").alias("j"), F.lit(2).alias("role"))
    asks = many.where("minor").select("s", "id", "component", F.pmod(F.xxhash64("id", F.lit(1)), "deep").alias("i"), upto("wide").alias("j"), F.lit(1).alias("role"))
    cells = one.unionByName(answers).unionByName(asks).join(reps.join(first, "id"), "id").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "n", "id")
    found = arrow_map(cells.select("s", "i", "j", "n", "id", "component", "role", "point", "first"), _second_step, "a long, b long, worth long")
    found = materialize(found.groupBy("a", "b").agg(F.max("worth").alias("worth")).join(tried, ["a", "b"], "left_anti"), "candidates")

    # Of these, first one for each set and each component it could join, then whatever still lies between two.
    part = known.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    best = found.join(part, "b", "left").withColumn("cb", F.coalesce("cb", "b"))
    best = best.groupBy("a", "cb").agg(F.max_by("b", F.struct("worth", -F.col("b"))).alias("b"))
    best = materialize(best.select("a", "b").distinct(), "best")
    links = materialize(links.unionByName(verify(best, source, points)), "links")
    known = linked(links)
    rest = found.join(best, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(known.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    rest = materialize(rest.where("ca <> cb").select("a", "b"), "rest")
    if rest.limit(1).count():
        known = linked(materialize(links.unionByName(verify(rest, source, points)), "links"))

    named = copies.join(known.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    named = materialize(named.unionByName(known).groupBy("id").agg(F.min("component").alias("component")), "groups")
    # The component's name is its smallest member: a representative is the smallest of its class, so of its component, too.
    out = points.select("id", "n").join(broadcast_if_small(named, BROADCAST_IDS), "id", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are not the first of their group."""
    gone = groups(docs, key, text).where(F.col("component_id") != F.col(key)).select(F.col(key))
    return docs.join(broadcast_if_small(materialize(gone, "gone"), BROADCAST_IDS), key, "left_anti").select(*docs.columns)


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
g as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) s from w),
n as (select doc_id, count(*) n from g group by 1),
p as (select x.doc_id a, y.doc_id b, count(*) c from g x join g y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(id, reach) as (select doc_id, doc_id from documents union select r.id, e.b from r join e on e.a = r.reach)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, min(r.reach) component_id
from documents d left join n on n.doc_id = d.doc_id join r on r.id = d.doc_id group by 1, 2"""
