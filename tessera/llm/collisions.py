"""Approximate nearest neighbours by collision counting.

Method: each of ``PROJECTIONS`` random directions gives a vector one number. An index block holds its vectors and, for
each direction, their numbers in sorted order. A query opens a window centred on its own number in every sorted array;
the window's half-width is ``HALF`` times a radius that grows by ``GROWTH`` (virtual rehashing: the same arrays serve all
radii), and only what a step adds is counted. A vector that lies in at least ``threshold()`` of the windows has collided
often enough and is verified: its distance is computed. A query is done with a block when its k-th best distance is within
the radius, or the windows hold the whole block. A vector within the radius falls into a window with probability
erf(HALF / sqrt 2) = 0.83 and the threshold lies 1.65 standard deviations below the mean count, so each true neighbour is
verified with a probability of 0.95 at least, and the nearer the likelier. No count of candidates ends a search.

The index covers every row; directions come from a seed, nothing is fitted. Blocks are rows of a written table, queries
are broadcast in blocks of bounded size, and a task keeps each query's k best over its blocks, so a later block opens
its windows at the radius that is still of use at once.

Defined results: vectors that are null, all zero or empty, or that hold null or non-finite components take no part,
neither do null keys; keys are integers; shorter vectors count as filled up with zeros; a vector with a component beyond
``FAR`` has no usable projection and is verified against every query, and a query like that against every vector, so
nothing is lost; equal distances go to the smaller key; a query with fewer than k other rows gets them all; rows that
repeat a key are candidates of their own, except to queries of that key, and queries that repeat a key are answered once; a
distance beyond the doubles is infinite; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import arrow_map
from tessera.llm.vectors import blocks, column, filled, finite, gather, matrix, rows_at_most
from tessera.storage import materialize, scratch

PROJECTIONS, HALF, GROWTH, DEVIATIONS = 64, 1.36, 1.25, 1.65
BLOCK, QUERIES = 16384, 16384
FAR = 1e100
#: Numbers are held as offsets of 32 bits: windows give way by this share of the block's spread.
GIVE = 1e-6
INDEX = "ids array<long>, vectors binary, middle binary, numbers binary, sorted binary, far binary"
SEED = 12


def threshold(projections: int = PROJECTIONS) -> int:
    p = math.erf(HALF / math.sqrt(2))
    return max(1, math.floor(projections * p - DEVIATIONS * math.sqrt(projections * p * (1 - p))))


def directions(width: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, projections))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean, in doubles; scaled where squares leave their range."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        d = rows - query
        out = np.sqrt((d * d).sum(axis=1))
        odd = ~np.isfinite(out) | (out < 1e-150)
        if odd.any():
            top = np.abs(d[odd]).max(axis=1, initial=0)
            safe = np.where((top > 0) & np.isfinite(top), top, 1)
            out[odd] = np.where(np.isfinite(top), top * np.sqrt(((d[odd] / safe[:, None]) ** 2).sum(axis=1)), np.inf)
    return out


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))


def build(vectors: DataFrame, width: int, projections: int = PROJECTIONS) -> DataFrame:
    """The index: a row for each block of vectors, a lazy table."""
    names = [f.split()[0] for f in INDEX.split(", ")]

    def run(batches):
        axes = directions(width, projections)
        for t in gather(batches, rows_at_most(width, BLOCK)):
            ids, rows = column(t, "id"), matrix(column(t, "v"), width)
            far = np.abs(rows).max(axis=1, initial=0) > FAR
            order = np.argsort(far, kind="stable")
            rows, far = rows[order], int(far.sum())
            near = rows[: len(rows) - far] @ axes
            middle = near.mean(axis=0) if len(near) else np.zeros(projections)
            near = (near - middle).astype(np.float32).T
            at = np.argsort(near, axis=1, kind="stable")
            narrow = rows.astype(np.float32) if far == 0 else rows
            held = narrow if (narrow == rows).all() else rows
            data = [held.tobytes(), middle.tobytes(), np.take_along_axis(near, at, axis=1).tobytes(), at.astype(np.uint16).tobytes(), far.to_bytes(4, "little")]
            yield pa.RecordBatch.from_arrays([pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), *(pa.array([d], pa.binary()) for d in data)], names)

    return arrow_map(vectors, run, INDEX)


class Nearest:
    """The k nearest of one query so far, by distance and key."""

    __slots__ = ("far", "ids", "k")

    def __init__(self, k: int):
        self.k, self.ids, self.far = k, np.empty(0, np.int64), np.empty(0)

    @property
    def reach(self) -> float:
        return float(self.far[-1]) if len(self.far) == self.k else math.inf

    def offer(self, ids: np.ndarray, far: np.ndarray) -> None:
        ids, far = np.concatenate((self.ids, ids)), np.concatenate((self.far, far))
        if len(far) > 4 * self.k:
            few = far <= np.partition(far, self.k - 1)[self.k - 1]
            ids, far = ids[few], far[few]
        order = np.lexsort((ids, far))[: self.k]
        self.ids, self.far = ids[order], far[order]


class Block:
    """An index row, opened."""

    def __init__(self, row: dict, width: int, projections: int):
        self.ids = np.array(row["ids"], np.int64)
        n = len(self.ids)
        self.rows = np.frombuffer(row["vectors"], np.float32 if len(row["vectors"]) == 4 * n * width else np.float64).astype(np.float64).reshape(n, width)
        self.middle = np.frombuffer(row["middle"])
        self.near = n - int.from_bytes(row["far"], "little")
        self.numbers = np.frombuffer(row["numbers"], np.float32).reshape(projections, self.near)
        self.sorted = np.frombuffer(row["sorted"], np.uint16).reshape(projections, self.near)
        self.give = GIVE * np.maximum(np.abs(self.numbers[:, 0]), np.abs(self.numbers[:, -1])) if self.near else np.zeros(projections)

    def verify(self, at: np.ndarray, own: int, query: np.ndarray, best: Nearest) -> int:
        at = at[self.ids[at] != own]
        best.offer(self.ids[at], distances(self.rows[at], query))
        return len(at)

    def windows(self, numbers: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window (a row of ``numbers``, half-widths ``half``) begins and ends in each sorted array."""
        slack = self.give + GIVE * np.abs(numbers)
        low, high = (numbers - half[:, None] - slack).T, (numbers + half[:, None] + slack).T
        sides = [(np.searchsorted(v, a, "left"), np.searchsorted(v, b, "right")) for v, a, b in zip(self.numbers, low, high, strict=True)]
        return np.array([s[0] for s in sides]).T, np.array([s[1] for s in sides]).T

    def first_radius(self, numbers: np.ndarray, k: int) -> np.ndarray:
        """A radius whose windows hold a few times k vectors, by the median of the directions."""
        n = min(4 * k, self.near)
        gaps = []
        for v, x in zip(self.numbers, numbers.T, strict=True):
            at = np.clip(np.searchsorted(v, x) - n // 2, 0, self.near - n)
            gaps.append(np.maximum(np.abs(v[at] - x), np.abs(v[at + n - 1] - x)))
        return np.maximum(np.median(gaps, axis=0), 1e-9 * float(np.abs(self.numbers).max()) + 1e-300) / HALF

    def search(self, own: np.ndarray, queries: np.ndarray, axes: np.ndarray, best: list[Nearest]) -> int:
        """Offers each query what it verifies here; returns how many vectors were verified."""
        done, least = 0, threshold(len(self.numbers))
        far = np.arange(self.near, len(self.ids))
        wild = np.abs(queries).max(axis=1, initial=0) > FAR
        for q in range(len(own)):
            if len(far) or wild[q]:
                done += self.verify(np.arange(len(self.ids)) if wild[q] else far, own[q], queries[q], best[q])
        live = np.flatnonzero(~wild)
        if not self.near or not len(live):
            return done
        numbers = queries[live] @ axes - self.middle
        reach = np.array([best[q].reach for q in live])
        radius = np.where(np.isfinite(reach), reach, self.first_radius(numbers, best[0].k))
        for some in np.array_split(np.arange(len(live)), -(-len(live) // 256)):  # counts of 256 queries at a time
            done += self._grow(live[some], numbers[some], radius[some], own, queries, best, least)
        return done

    def _grow(self, live, numbers, radius, own, queries, best, least) -> int:
        done = 0
        counts = np.zeros((len(live), self.near), np.uint16)
        seen = np.zeros((len(live), self.near), bool)
        left, right = (np.full((len(live), len(self.numbers)), np.nan),) * 2
        active, opened = np.arange(len(live)), False
        while len(active):
            low, high = self.windows(numbers[active], HALF * radius[active])
            old_low, old_high = (left[active].astype(int), right[active].astype(int)) if opened else (low, low)
            for i, q in enumerate(active):
                pieces = [self.sorted[j, a:b] for j in range(len(self.numbers)) for a, b in ((low[i, j], old_low[i, j]), (old_high[i, j], high[i, j])) if b > a]
                if pieces:
                    counts[q] += np.bincount(np.concatenate(pieces), minlength=self.near).astype(np.uint16)
                    at = np.flatnonzero((counts[q] >= least) & ~seen[q])
                    if len(at):
                        seen[q, at] = True
                        done += self.verify(at, own[live[q]], queries[live[q]], best[live[q]])
            left, right = left.copy(), right.copy()
            left[active], right[active], opened = low, high, True
            reach = np.array([best[live[q]].reach for q in active])
            whole = (low == 0).all(axis=1) & (high == self.near).all(axis=1)
            on = (reach > radius[active]) & ~whole
            radius[active] = np.minimum(radius[active] * GROWTH, reach)
            active = active[on]
        return done


def search(index: DataFrame, asked: list, width: int, k: int, projections: int = PROJECTIONS) -> DataFrame:
    """(query_id, id, score, verified) of one block of queries, the k best of each in each task."""
    own, queries = np.array([r[0] for r in asked], np.int64), filled([r[1] for r in asked], width)
    shared = index.sparkSession.sparkContext.broadcast((own, queries))

    def run(batches):
        own, queries = shared.value
        axes, best = directions(width, projections), [Nearest(k) for _ in own]
        done = 0
        for b in batches:
            for i in range(b.num_rows):
                done += Block(b.slice(i, 1).to_pylist()[0], width, projections).search(own, queries, axes, best)
        size = [len(x.ids) for x in best]
        if sum(size):
            found = [pa.array(np.repeat(own, size)), pa.array(np.concatenate([x.ids for x in best])), pa.array(np.concatenate([x.far for x in best]))]
            yield pa.RecordBatch.from_arrays([*found, pa.array(np.r_[done, np.zeros(sum(size) - 1, np.int64)])], ["query_id", "id", "score", "verified"])

    return arrow_map(index, run, "query_id long, id long, score double, verified long")


def neighbours(df: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", every: int = 100) -> DataFrame:
    """(query_id, rank, key, score): for each row whose key is divisible by ``every``, its k nearest other rows found."""
    spark = df.sparkSession
    vectors = usable(df, key, vector)
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    with scratch(spark):
        index = materialize(build(vectors, width), "collisions", keep=True)
        asked = materialize(vectors.where(F.col("id") % every == 0).dropDuplicates(["id"]), "queries")
        found = [search(index, block, width, k) for block in blocks(asked, rows_at_most(width, QUERIES))]
    if not found:
        return vectors.selectExpr("id as query_id", "0 as rank", f"id as `{key}`", "0D as score").where("false")
    w = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
