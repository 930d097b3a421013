"""Vectors as array<double>: similarity, recommendation, centroids."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.tables import top_n_per_group
from tessera.storage import broadcast_if_small, materialize, scratch

# Weights of the similarity views.
VIEW_WEIGHTS = {"emotion": 0.45, "style": 0.30, "audio": 0.25}
#: Vectors of a block at least and at most (16,384 of 64 floats: 4 MB), and how many blocks there are before they grow.
#: Blocks meet block to block, and no block is shuffled for that: a task reads its own and a part of all, of about PART
#: bytes, and works on two at a time.
BLOCK, LARGEST, BLOCKS, PART = 2000, 16_384, 32, 128 << 20
#: Stands for no label beside whole numbers.
NONE = -(1 << 63)
#: Similarities that are held at once.
TOGETHER = 512_000
#: Parts of a row of similarities whose maxima bound its k-th best from below.
PARTS = 64
#: Rows that the starts of k-means are drawn from.
SEEDED = 5000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(df: DataFrame, vector: str, out: str = "u") -> DataFrame:
    """Each vector over its norm, once before any pairing; a zero vector stays zero."""
    n = F.when(norm(F.col(vector)) == 0, 1.0).otherwise(norm(F.col(vector)))
    return df.withColumn("_n", n).withColumn(out, F.transform(vector, lambda x: x / F.col("_n"))).drop("_n")


def cosine_top_k(df: DataFrame, id_: str, vector: str, k: int, least: float | None = None, apart: str | None = None) -> DataFrame:
    """(source, target, similarity, rank) of each row's k nearest others, rounded to 6 places before
    ranking; ``apart``: only others with another value of this column (rows without one take no part).

    The rows are cut into blocks that meet block to block; the meetings of a block in one task keep k candidates of a
    source, so what is shuffled is k rows a source and part of the blocks, never all pairs.
    """
    return top_n_per_group(_near(df, id_, vector, k, least, None, apart), ["source"], [F.desc("similarity"), F.col("target")], k)


def cosine_above(df: DataFrame, id_: str, vector: str, least: float) -> DataFrame:
    """V2: all ordered pairs (source, target, similarity) of at least this similarity."""
    return _near(df, id_, vector, None, None, least, None)


def cosine_neighbours(df: DataFrame, id_: str, vector: str, k: int, above: float) -> DataFrame:
    """G1: ordered pairs of positive similarity that hold each row's k nearest others and all of at least ``above``."""
    return _near(df, id_, vector, k, 1e-6, above, None)


def cosine_graph(df: DataFrame, id_: str, vector: str, k: int, least: float, label: str | None = None) -> DataFrame:
    """G1: the edges of ``edges_from_pairs`` without a shuffle of the pairs: the k nearest of each row come first, and the
    last of them goes with its row into the meetings of blocks, where a pair of at least ``least`` is complete. Repeated
    ids need the pairs grouped. ``label``: a column of whole numbers of up to 53 bits, which the edges bring along for
    their ends as la and lb, without a join."""
    from tessera.operators.graph import edges_from_pairs

    kept = [F.coalesce(F.col(label).cast("long"), F.lit(NONE)).alias("apart")] if label else [F.lit(0).cast("long").alias("apart")]
    rows = df.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), *kept, F.col(vector).cast("array<double>").alias("v"))

    def named(edges):
        ends = [df.select(F.col(id_).cast("long").alias(end), F.col(label).cast("long").alias(f"l{end}")) for end in "ab"]
        return edges.join(ends[0], "a").join(ends[1], "b")

    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        found = edges_from_pairs(cosine_neighbours(df, id_, vector, k, least), k, least)
        return found if label is None else named(found)
    near = materialize(cosine_top_k(rows, "id", "v", k, 1e-6), "near")
    # Ids of over 53 bits are no whole numbers as floats: the bar's id goes in two halves.
    last = near.where(F.col("rank") == k).select(F.col("source").alias("id"), F.array("similarity", F.shiftright("target", 32).cast("double"), F.col("target").bitwiseAND(0xFFFFFFFF).cast("double")).alias("bar"))
    rows = rows.join(last, "id", "left").select("id", "apart", "v", F.coalesce("bar", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("bar"))

    def each(row, m, n):
        own, other = (np.frombuffer(row[f"ids_{side}"], np.int64) for side in "ab")
        x, y = (side[0] / np.maximum(np.linalg.norm(side[0], axis=1, keepdims=True), 1e-300) for side in (m, n))
        bars = [(side[1][:, 0], side[1][:, 1].astype(np.int64) * (1 << 32) + side[1][:, 2].astype(np.int64)) for side in (m, n)]
        meets_itself, step = bool(len(np.intersect1d(own, other))), together(len(other))
        for a in range(0, len(own), step):
            i, j = np.nonzero((s := x[a : a + step] @ y.T) >= least - 2e-6)
            v = _rounded(s[i, j])
            keep = (v >= least) & (v > 0) & ((own[a + i] < other[j]) if meets_itself else True)
            i, j, v = a + i[keep], j[keep], v[keep]
            count = np.zeros(len(v))
            for (bar, at), one, target in ((bars[0], i, other[j]), (bars[1], j, own[i])):
                count += (v > bar[one]) | ((v == bar[one]) & (target <= at[one]))
            labels = [np.frombuffer(row[f"apart_{side}"], np.int64)[at] for side, at in (("a", i), ("b", j))] if label else []
            labels = [np.where(c == NONE, np.nan, c.astype(float)) for c in labels]
            first = own[i] < other[j]
            yield [np.minimum(own[i], other[j]), np.maximum(own[i], other[j]), v, count, *(np.where(first, x, y) for x, y in zip(labels, labels[::-1], strict=True))]

    brought = ["la", "lb"] if label else []
    over = _meet(rows, ["v", "bar"], each, [(c, pa.float64()) for c in ("weight", "near", *brought)], unit_rows=False, both=False)
    over = over.select(*(F.col(c).cast("long").alias(c) for c in brought), F.col("source").alias("a"), F.col("target").alias("b"), "weight", F.lit(True).alias("by_threshold"), (F.col("near") > 0).alias("by_top_k"), (F.col("near") == 2).alias("mutual_top_k"))
    under = near.where(F.col("similarity") < least).groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    under = under.agg(F.max("similarity").alias("weight"), F.count("*").alias("near")).select("a", "b", "weight", F.lit(False).alias("by_threshold"), F.lit(True).alias("by_top_k"), (F.col("near") == 2).alias("mutual_top_k"))
    return over.unionByName(named(under) if label else under).withColumn("distance", 1 - F.col("weight"))


def cosine_grid(df: DataFrame, id_: str, views: list[str]) -> DataFrame:
    """(source, target, one similarity a view) of every ordered pair of different rows; a view that either
    side lacks is null. As many rows as there are pairs, by its nature."""

    def each(row, m, n):
        own, other = (np.frombuffer(row[x], np.int64) for x in ("ids_a", "ids_b"))
        step = together(len(other))
        for a in range(0, len(own), step):
            apart = own[a : a + step, None] != other[None, :]
            i, j = np.nonzero(apart)
            yield [own[a + i], other[j], *(_similarity(x[a : a + step], y)[i, j] for x, y in zip(m, n, strict=True))]

    fields = [(v, pa.float64()) for v in views]
    return _meet(df.select(F.col(id_).cast("long").alias("id"), F.lit(0).cast("long").alias("apart"), *(F.col(v).cast("array<double>").alias(v) for v in views)), views, each, fields)


def grid_counts(df: DataFrame, id_: str) -> DataFrame:
    """(rows, self_pairs, repeated_pairs) of each meeting of two blocks of ``cosine_grid``: all pairs of two ids come
    from the same meeting, and those beyond the first are those of an id's further rows. No pair leaves its task."""

    def each(row, m, n):
        own, other = (np.frombuffer(row[x], np.int64) for x in ("ids_a", "ids_b"))
        first, second = np.unique(own, return_index=True)[1], np.zeros(len(other), bool)
        second[np.unique(other, return_index=True)[1]] = True
        is_first, step = np.isin(np.arange(len(own)), first), together(len(other))
        found = np.zeros(3)
        for a in range(0, len(own), step):
            part = own[a : a + step, None]
            apart = part != other[None, :]
            count = np.count_nonzero(apart)
            found += count, np.count_nonzero(apart & (part == other[None, :])), count - np.count_nonzero(apart[is_first[a : a + step]] & second)
        yield [own[:1], other[:1], *(np.array([x]) for x in found)]

    rows = df.select(F.col(id_).cast("long").alias("id"), F.lit(0).cast("long").alias("apart"))
    names = ("rows", "self_pairs", "repeated_pairs")
    return _meet(rows, [], each, [(x, pa.float64()) for x in names]).select(*(F.col(x).cast("long").alias(x) for x in names))


def grid_totals(df: DataFrame, id_: str, views: list[str]) -> DataFrame:
    """V6: of the pairs of ``cosine_grid`` (source, and for each view how many it has, their sum and the best), a few rows
    a source: both orders of two blocks are summed from one product, and no pair leaves its task."""

    def each(row, m, n):
        own, other = (np.frombuffer(row[x], np.int64) for x in ("ids_a", "ids_b"))
        meets_itself, step = bool(len(np.intersect1d(own, other))), together(len(other))
        sums = [[np.zeros((2, len(ids))) for _ in views] for ids in (own, other)]
        best = [[np.full(len(ids), -np.inf) for _ in views] for ids in (own, other)]
        for v, (x, y) in enumerate(zip(m, n, strict=True)):
            has, have = ~np.isnan(x).any(axis=1), ~np.isnan(y).any(axis=1)
            x, y = np.where(has[:, None], x, 0), np.where(have[:, None], y, 0)
            for a in range(0, len(own), step):
                part = slice(a, a + step)
                s = _similarity(x[part], y)
                same = own[part, None] == other[None, :] if meets_itself else None
                if meets_itself:
                    s[same] = 0
                    there = has[part, None] & have[None, :] & ~same
                    counts = there.sum(axis=1), there.sum(axis=0)
                else:
                    counts = has[part] * have.sum(), have * has[part].sum()
                sums[0][v][:, part] += counts[0], s.sum(axis=1)
                sums[1][v] += counts[1], s.sum(axis=0)
                s[~has[part]], s[:, ~have] = -np.inf, -np.inf
                if meets_itself:
                    s[same] = -np.inf
                best[0][v][part] = np.maximum(best[0][v][part], s.max(axis=1))
                best[1][v] = np.maximum(best[1][v], s.max(axis=0))
        for side, ids in enumerate((own,) if meets_itself else (own, other)):
            yield [ids, np.zeros(len(ids), np.int64), *(c for v in range(len(views)) for c in (*sums[side][v], np.where(np.isinf(best[side][v]), np.nan, best[side][v])))]

    fields = [(f"{k}_{v}", pa.float64()) for v in views for k in ("pairs", "sum", "best")]
    rows = df.select(F.col(id_).cast("long").alias("id"), F.lit(0).cast("long").alias("apart"), *(F.col(v).cast("array<double>").alias(v) for v in views))
    return _meet(rows, views, each, fields, both=False).drop("target")


def grid_best(df: DataFrame, id_: str, views: Mapping[str, float], k: int, least: float, same: str) -> DataFrame:
    """V9: those pairs of ``cosine_grid`` that hold each row's k best partners of the same ``same`` by the weighted mean of
    the views that both have, if that is at least ``least``, as a few rows a source and block."""
    names, w = list(views), np.array(list(views.values()))

    def each(row, m, n):
        own, other, g, h = (np.frombuffer(row[x], np.int64) for x in ("ids_a", "ids_b", "apart_a", "apart_b"))
        meets_itself, step = bool(len(np.intersect1d(own, other))), together(len(other))
        has, have = (np.stack([~np.isnan(x).any(axis=1) for x in side], axis=1) for side in (m, n))
        # One product gives the weighted sums, another the weights; where no view is shared both are 0.
        x, y = (np.concatenate([np.where(there[:, [i]], v, 0) * w[i] ** 0.5 for i, v in enumerate(side)], axis=1) for side, there in ((m, has), (n, have)))
        for a in range(0, len(own), step):
            part = slice(a, a + step)
            weight = (has[part] * w) @ have.T.astype(float)
            s = np.where(weight > 0, (x[part] @ y.T) / np.where(weight > 0, weight, 1), -2)
            s[g[part, None] != h[None, :]] = -2
            if meets_itself:
                s[own[part, None] == other[None, :]] = -2
            # Each view's similarity is rounded by at most half of 1e-6, and so is their mean.
            i, j = np.nonzero(s >= np.maximum(np.maximum(_least_of_best(s, k), least) - 2e-6, -1.5)[:, None])
            each_view = [_rounded((v[a + i] * u[j]).sum(axis=1)) for v, u in zip(m, n, strict=True)]
            there = has[a + i] & have[j]
            mean = sum(np.where(there[:, c], q, 0) * w[c] for c, q in enumerate(each_view)) / np.maximum((there * w).sum(axis=1), 1e-300)
            # Of equal means only the k of the smallest ids can be among the best; means that nearly equal the k-th all stay.
            order = np.lexsort((other[j], -mean, i))
            i, j, mean = i[order], j[order], mean[order]
            start = np.searchsorted(i, i, side="left")
            last = np.minimum(start + k, np.searchsorted(i, i, side="right")) - 1
            fresh = np.r_[True, (i[1:] != i[:-1]) | (mean[1:] != mean[:-1])] if len(i) else np.zeros(0, bool)
            alike = np.arange(len(i)) - np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0))
            keep = (alike < k) & (mean >= mean[last] - 2e-9)
            yield [own[a + i[keep]], other[j[keep]], *(q[order][keep] for q in each_view)]

    rows = df.where(F.col(same).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.xxhash64(same).alias("apart"), *(F.col(v).cast("array<double>").alias(v) for v in names))
    return _meet(rows, names, each, [(v, pa.float64()) for v in names])


def together(width: int) -> int:
    """Sources whose similarities to ``width`` others are held at once."""
    return max(1, TOGETHER // max(1, width))


def similar_to(df: DataFrame, id_: str, value, views: list[str]) -> DataFrame:
    """(source, target, one similarity a view) of one row against all others: one scan, its vectors as constants."""
    u = df.select(F.col(id_).alias("target"), *views)
    for v in views:
        u = unit(u, v, f"_{v}")
    one = u.where(F.col("target") == value).limit(1).select(F.col("target").alias("source"), *(F.col(f"_{v}").alias(f"_s_{v}") for v in views))
    return u.where(F.col("target") != value).crossJoin(F.broadcast(one)).select("source", "target", *(F.round(dot(F.col(f"_s_{v}"), F.col(f"_{v}")), 6).alias(v) for v in views))


def _rounded(s: np.ndarray) -> np.ndarray:
    """To 6 places, halves away from zero."""
    s = np.clip(s, -1, 1)
    return np.floor(np.abs(s) * 1e6 + 0.5) / 1e6 * np.sign(s)


def _similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of unit rows to 6 places; NaN where a side has no vector."""
    return _rounded(x @ y.T)


def _least_of_best(s: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that its k-th best is not below: the k-th largest maximum of its parts."""
    width = max(1, s.shape[1] // PARTS)
    parts = s.shape[1] // width
    if parts < k:
        return np.full(len(s), -np.inf)
    tops = s[:, : parts * width].reshape(len(s), parts, width).max(axis=2)
    return np.partition(tops, parts - k, axis=1)[:, parts - k]


def _near(df: DataFrame, id_: str, vector: str, k: int | None, least: float | None, above: float | None, apart: str | None) -> DataFrame:
    rows = df.select(F.col(id_).cast("long").alias("id"), (F.xxhash64(apart) if apart else F.lit(0).cast("long")).alias("apart"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.lit(True) if apart is None else df[apart].isNotNull()))
    low = -1 if least is None else least

    def each(row, m, n, held=None):
        own, other, g, h = (np.frombuffer(row[x], np.int64) for x in ("ids_a", "ids_b", "apart_a", "apart_b"))
        x, y = m[0], n[0]
        if apart is not None:  # rows of one value stand together, so what does not count is a run of columns
            p, q = np.argsort(g, kind="stable"), np.argsort(h, kind="stable")
            own, other, g, h, x, y = own[p], other[q], g[p], h[q], x[p], y[q]
        meets_itself, step = bool(len(np.intersect1d(own, other))), together(len(other))
        no_own, no_other = np.isnan(x).any(axis=1), np.flatnonzero(np.isnan(y).any(axis=1))
        # The nearest are looked for in single precision, and found in double.
        single = above is None
        margin = 2e-6 + (4e-7 * x.shape[1] if single else 0)
        left, right = (x.astype(np.float32), np.ascontiguousarray(y.T, np.float32)) if single else (x, y.T)
        space = np.empty((min(step, len(own)), len(other)), left.dtype)
        best = _kth_held(held, own, k) if held is not None else np.full(len(own), -np.inf)
        for a in range(0, len(own), step):
            s = np.matmul(left[a : a + step], right, out=space[: min(step, len(own) - a)])
            s[no_own[a : a + step]], s[:, no_other] = -2, -2
            if meets_itself:
                s[own[a : a + step, None] == other[None, :]] = -2
            if apart is not None:
                some = g[a : a + step]
                begin = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
                ends = zip(begin, np.r_[begin[1:], len(some)], np.searchsorted(h, some[begin], "left"), np.searchsorted(h, some[begin], "right"), strict=True)
                for top, bottom, first, last in ends:
                    s[top:bottom, first:last] = -2
            # Rounding moves a value by at most half of 1e-6, so none that counts is below these; only they are rounded.
            bar = np.full(len(s), np.inf if above is None else above)
            if k is not None:
                kth = best[a : a + step].copy()
                if len(unknown := np.flatnonzero(np.isinf(kth))):
                    kth[unknown] = _least_of_best(s if len(unknown) == len(s) else s[unknown], k)
                bar = np.minimum(bar, np.maximum(kth, low))
            bar = np.maximum(bar - margin, -1.5).astype(s.dtype)
            able_rows = np.flatnonzero(s.max(axis=1, initial=-2) >= bar)
            if len(able_rows) == len(s):
                i, j = np.nonzero(s >= bar[:, None])
            else:
                i, j = np.nonzero(s[able_rows] >= bar[able_rows, None])
                i = able_rows[i]
            v = _rounded(np.einsum("ij,ij->i", x[a + i], y[j]) if single else s[i, j])
            keep = v >= (2 if above is None else above)
            if k is not None:
                able = np.flatnonzero(v >= low)
                order = able[np.lexsort((other[j[able]], -v[able], i[able]))]
                first = np.searchsorted(i[order], i[order], side="left")
                keep[order[np.arange(len(order)) - first < k]] = True
            i, j = i[keep], j[keep]
            yield [own[a + i], other[j], v[keep]]

    return _meet(rows, ["v"], each, [("similarity", pa.float64())], merge=first_of(k, -1) if above is None else None, bars=above is None)


def _kth_held(held: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """The k-th best value that earlier meetings of a block found for each of its rows; -inf where they found fewer."""
    if not len(held[0]):
        return np.full(len(own), -np.inf)
    last = np.searchsorted(held[0], own, side="right")
    full = last - np.searchsorted(held[0], own, side="left") >= k
    return np.where(full, held[2][np.maximum(last - 1, 0)], -np.inf)


def first_of(k: int, sign: int):
    """A ``merge`` of (source, target, value): each source's k rows of the least ``sign`` * value, ties to the smaller target."""

    def merge(columns: list[np.ndarray]) -> list[np.ndarray]:
        source, target, value = columns
        order = np.lexsort((target, sign * value, source))
        source = source[order]
        keep = np.arange(len(source)) - np.searchsorted(source, source, side="left") < k
        return [source[keep], target[order[keep]], value[order[keep]]]

    return merge


def sums_of(columns: list[np.ndarray]) -> list[np.ndarray]:
    """A ``merge`` of (source, target, values): a row a source, its values summed."""
    ids, at = np.unique(columns[0], return_inverse=True)
    return [ids, np.zeros(len(ids), np.int64), *(np.bincount(at, c, len(ids)) for c in columns[2:])]


def _meet(rows: DataFrame, views: list[str], each, fields: list[tuple[str, pa.DataType]], unit_rows: bool = True, both: bool = True, merge=None, bars: bool = False) -> DataFrame:
    """``each`` of two packed blocks (of vectors over their norms, if ``unit_rows``), for all ordered pairs of blocks. Rows
    (id, apart, a vector a view) are dealt into blocks by hash, a block packed into one row of arrays (of floats, where
    they hold the values) in a file of its own, and this table is joined with itself without a shuffle: a task reads some
    blocks, and holds a part of all of about PART bytes that each of them meets in turn. ``merge``: the rows of a block
    are merged from meeting to meeting, and leave the task once; with ``bars``, ``each`` gets what is held. Without ``both``, ``each`` gets two blocks in one order
    only and answers for both."""
    with scratch(rows.sparkSession):
        blobs, blocks, width, size = _packed(rows.where("id is not null"), views)
    names = ["ids", "apart", *views]
    parts = -(-blocks // max(1, PART // size))
    left = blobs.select("block", *(F.col(n).alias(f"{n}_a") for n in names))
    right = blobs.coalesce(parts).select(F.col("block").alias("other"), *(F.col(n).alias(f"{n}_b") for n in names)).hint("shuffle_replicate_nl")
    if both:
        met = left.crossJoin(right)
    else:  # a block meets itself and those half way round; the one just half way round from one side only
        ahead, half = F.pmod(F.col("other") - F.col("block"), F.lit(blocks)), blocks // 2
        met = left.join(right, (ahead < half) | (ahead == half) & (F.lit(blocks % 2 == 1) | (F.col("block") < half)))
    out = ["source", "target", *(n for n, _ in fields)]

    def unpacked(buffer, n, size):
        m = np.frombuffer(buffer, np.float32 if len(buffer) == 4 * n * size else np.float64).reshape(n, size).astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if unit_rows else m

    def sent(found):
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, from_pandas=True) if x.dtype == np.float64 else pa.array(x) for x in found], out)

    def run(batches):
        now, held = None, None
        for b in batches:
            column = dict(zip(b.schema.names, b.columns, strict=True))
            for k in range(b.num_rows):  # one meeting at a time
                row = {f"{n}_{side}": column[f"{n}_{side}"][k].as_buffer() for n in names for side in "ab"}
                sides = [[unpacked(row[f"{v}_{side}"], len(row[f"ids_{side}"]) // 8, size) for v, size in zip(views, width, strict=True)] for side in "ab"]
                if merge is None:
                    for found in each(row, *sides):
                        yield from sent(found)
                    continue
                if held is not None and now != column["block"][k].as_py():
                    yield from sent(held)
                    held = None
                now = column["block"][k].as_py()
                if bars:
                    found = [*([held] if held is not None else []), *each(row, *sides, held)]
                else:
                    found = [*([held] if held is not None else []), *each(row, *sides)]
                held = merge([np.concatenate(c) for c in zip(*found, strict=True)]) if found else None
        if held is not None:
            yield from sent(held)

    return met.mapInArrow(run, ", ".join(("source long", "target long", *(f"`{n}` double" for n, _ in fields))))


def _packed(rows: DataFrame, views: list[str]) -> tuple[DataFrame, int, list[int]]:
    """(block, ids, apart, a matrix a view) as a written table of one row a file, how many blocks, the views' widths and
    the bytes of a block at most, on average."""
    rows = materialize(rows, "vectors")
    count, *sizes = rows.agg(F.count("*"), *(F.max(F.size(v)) for v in views)).first()
    blocks = max(1, min(-(-count // BLOCK), max(BLOCKS, -(-count // LARGEST))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("block", "id", "apart", *views)
    width = [max(1, x or 0) for x in sizes]

    def packed(held):
        block, parts = held
        arrays = [np.concatenate(x) for x in zip(*parts, strict=True)]
        for v in range(len(views)):
            with np.errstate(over="ignore"):
                small = arrays[2 + v].astype(np.float32)
            if np.array_equal(small, arrays[2 + v], equal_nan=True):
                arrays[2 + v] = small
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays)], ["block", "ids", "apart", *views])

    def matrix(column, size):
        if not column.null_count:
            flat = column.flatten()
            if not flat.null_count:
                return flat.to_numpy().reshape(len(column), size)
        return np.array([x if x is not None else [np.nan] * size for x in column.to_pylist()], np.float64).reshape(len(column), size)

    def pack(batches):
        held = None
        for b in batches:
            number = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, e in zip(cut, cut[1:], strict=False):
                if a == e:
                    continue
                some = b.slice(a, e - a)
                part = [some.column(1).to_numpy(), some.column(2).to_numpy(), *(matrix(some.column(3 + v), width[v]) for v in range(len(views)))]
                if held is not None and held[0] != int(number[a]):
                    yield packed(held)
                    held = None
                held = (int(number[a]), [*(held[1] if held else []), part])
        if held is not None:
            yield packed(held)

    names = ["ids", "apart", *views]
    schema = "block int, " + ", ".join(f"`{n}` binary" for n in names)
    return materialize(rows.repartition("block").sortWithinPartitions("block", "id").mapInArrow(pack, schema), "blocks", keep=True, rows_a_file=1), blocks, width, 8 * (2 + sum(width)) * -(-max(1, count) // blocks)


def hybrid(views: Mapping[str, float]) -> tuple[Column, Column]:
    """V4: weighted mean over the views that are there, and how many they are; null with none."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in views.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in views.items()), F.lit(0.0))
    used = sum((F.col(c).isNotNull().cast("int") for c in views), F.lit(0))
    return F.try_divide(total, F.when(weight > 0, weight)), used


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """The mean vector of each group, by position; partial sums are made before the shuffle."""
    flat = df.where(F.col(group).isNotNull()).select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    mean = flat.groupBy(group, "i").agg(F.avg("x").alias("x"))
    return mean.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def nearest_groups(c: DataFrame, group: str, n: int) -> DataFrame:
    """The n nearest other centroids of each group, and how far the two stand apart in the groups' order; groups are
    few, so their pairs are."""
    c = c.withColumn("_o", F.dense_rank().over(Window.orderBy(group)))  # one row a group
    a, b = c.select(F.col(group).alias("a"), F.col("centroid").alias("ca"), F.col("_o").alias("oa")), c.select(F.col(group).alias("b"), F.col("centroid").alias("cb"), F.col("_o").alias("ob"))
    pairs = a.join(broadcast_if_small(b, 10_000), F.col("a") != F.col("b")).select("a", "b", F.round(distance(F.col("ca"), F.col("cb")), 6).alias("distance"), F.abs(F.col("oa") - F.col("ob")).cast("long").alias("order_gap"))
    return top_n_per_group(pairs, ["a"], [F.col("distance"), F.col("b")], n)


def dispersion(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Root of the summed sample variances; null counts as 0."""
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return df.groupBy(group).agg(F.sqrt(F.pow(sd(x), 2) + F.pow(sd(y), 2)).alias("dispersion"))


def pca(df: DataFrame, id_: str, features: list[str], k: int = 2) -> tuple[DataFrame, DataFrame, list[float]]:
    """Scores pc1.., loadings (feature, component, loading) and explained shares of z-scored features.

    The covariance comes from one aggregation (features squared in size); only that comes to the driver. The sign of a
    component makes its largest loading positive.
    """
    from tessera.operators.tables import zscores

    z = zscores(df.select(id_, *features), features, impute=True)
    cov = _mean_products(z, features)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)[:k]
    load = vector[:, order]
    load = load * np.sign(load[np.abs(load).argmax(axis=0), range(load.shape[1])])
    scores = z.select(id_, *(sum((F.col(f) * float(load[i, c]) for i, f in enumerate(features)), F.lit(0.0)).alias(f"pc{c + 1}") for c in range(len(order))))
    listed = [(f, c + 1, float(load[i, c])) for i, f in enumerate(features) for c in range(len(order))]
    return scores, df.sparkSession.createDataFrame(listed, "feature string, component int, loading double"), [float(v) for v in value[order] / max(value.sum(), 1e-300)]


def _mean_products(z: DataFrame, features: list[str]) -> np.ndarray:
    """The mean product of every two columns: each task sends one matrix (features squared), summed on the driver."""
    size = len(features)

    def run(batches):
        total, n = np.zeros((size, size)), 0
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) if b.num_rows else np.zeros((0, size))
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["t", "n"])

    rows = z.select(*(F.col(f).cast("double") for f in features)).mapInArrow(run, "t binary, n long").collect()
    return sum((np.frombuffer(bytes(r[0])).reshape(size, size) for r in rows), np.zeros((size, size))) / max(1, sum(r[1] for r in rows))


def components_for(shares: list[float], target: float = 0.9) -> int:
    """The fewest components that explain ``target``."""
    return int(np.searchsorted(np.cumsum(shares), target - 1e-12) + 1)


def kmeans_select(df: DataFrame, id_: str, features: list[str], most: int = 8, seeds: int = 50, rounds: int = 100) -> tuple[DataFrame, int]:
    """Clusters 1.. of the k in 2..most with the highest Euclidean silhouette (ties to the smaller k).

    All models, every k from ``seeds`` starts, go through the same passes: a pass assigns each row in every model that
    still moves and sends one sum a model and task. Starts are drawn by k-means++ from the SEEDED rows of the smallest id
    hashes (all rows, if fewer). The silhouette is exact: distances to all rows, summed by cluster, block to block.
    Missing values are the median; fewer than three rows are one cluster.
    """
    from tessera.operators.tables import zscores

    z = materialize(zscores(df.select(F.col(id_).cast("long").alias("id"), *features), features, impute=True).select("id", F.array(*(F.col(f).cast("double") for f in features)).alias("v")), "scaled")
    n = z.count()
    if n < 3:
        return z.select(F.col("id").alias(id_), F.lit(1).alias("cluster")), 1
    some = np.array([r[0] for r in z.orderBy(F.xxhash64("id"), "id").limit(SEEDED).select("v").collect()])
    ks = range(2, min(most, n - 1) + 1)
    models = [[k, _spread_starts(some, k, np.random.default_rng(1000 * k + seed)), True] for k in ks for seed in range(seeds)]
    cost = np.zeros(len(models))
    for _ in range(rounds):
        live = [i for i, m in enumerate(models) if m[2]]
        if not live:
            break
        for i, (sums, sizes, total) in zip(live, _assign(z, [models[i][1] for i in live]), strict=True):
            old = models[i][1]
            new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], old)
            models[i][1], models[i][2], cost[i] = new, bool(np.abs(new - old).max() > 1e-4), total
    best = {k: models[min((i for i, m in enumerate(models) if m[0] == k), key=lambda i: (round(cost[i], 6), i))][1] for k in ks}
    named = materialize(_labels(z, best), "clusters")
    score = _silhouettes(named, list(best))
    k = min(best, key=lambda k: (-round(score[k], 9), k))
    return named.select(F.col("id").alias(id_), (F.col(f"c{k}") + 1).cast("int").alias("cluster")), k


def _spread_starts(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next start is drawn by its squared distance to the nearest before."""
    starts = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(1) for c in starts], axis=0)
        starts.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(starts)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(z: DataFrame, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each model the sum and number of the rows nearest to each centre, and the summed squared distances."""
    shared = z.sparkSession.sparkContext.broadcast(centres)
    cut = np.cumsum([0, *(len(c) for c in centres)])

    def run(batches):
        models = shared.value
        every = np.concatenate(models)
        half = (every * every).sum(1)
        sums, sizes, cost = np.zeros(every.shape), np.zeros(len(every)), np.zeros(len(models))
        for b in batches:
            x = _rows(b.column(0))
            d = half - 2 * (x @ every.T)
            for i, (a, e) in enumerate(zip(cut, cut[1:], strict=False)):
                near = d[:, a:e].argmin(axis=1)
                one = np.eye(e - a)[near]
                sums[a:e] += one.T @ x
                sizes[a:e] += one.sum(0)
                cost[i] += d[np.arange(len(x)), a + near].sum() + (x * x).sum()
        if sizes.any():
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (sums, sizes, cost)], ["sums", "sizes", "cost"])

    rows = z.select("v").mapInArrow(run, "sums binary, sizes binary, cost binary").collect()
    sums, sizes, cost = (sum(np.frombuffer(bytes(r[c])) for r in rows) for c in range(3))
    shared.destroy()
    sums = sums.reshape(len(sizes), -1)
    return [(sums[a:e], sizes[a:e], float(cost[i])) for i, (a, e) in enumerate(zip(cut, cut[1:], strict=False))]


def _labels(z: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(id, v, one column c<k> a model) with each row's cluster from 0."""
    shared = z.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for b in batches:
            x = _rows(b.column(1)) if b.num_rows else np.zeros((0, 1))
            near = [pa.array((((c * c).sum(1) - 2 * (x @ c.T)).argmin(axis=1) if len(x) else np.empty(0, int)).astype(np.int64)) for c in shared.value.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *near], ["id", "v", *(f"c{k}" for k in shared.value)])

    return z.select("id", "v").mapInArrow(run, "id long, v array<double>, " + ", ".join(f"c{k} long" for k in centres))


def _silhouettes(named: DataFrame, ks: list[int]) -> dict[int, float]:
    """The mean silhouette of each clustering, exactly: every distance, summed by cluster; no pair leaves its block."""
    size = {k: dict(named.groupBy(f"c{k}").count().collect()) for k in ks}
    code = sum((F.shiftleft(F.col(f"c{k}"), 6 * i) for i, k in enumerate(ks)), F.lit(0).cast("long"))  # up to ten clusterings of 64 clusters

    def each(row, m, n):
        own, other = (np.frombuffer(row[f"ids_{side}"], np.int64) for side in "ab")
        tag = np.frombuffer(row["apart_b"], np.int64)
        groups = np.concatenate([np.eye(k)[(tag >> 6 * i) & 63] for i, k in enumerate(ks)], axis=1)
        x, y = m[0], n[0]
        step = together(len(other))
        for a in range(0, len(own), step):
            part = x[a : a + step]
            d = np.sqrt(np.maximum(0, (part * part).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (part @ y.T)))
            d[own[a : a + step, None] == other[None, :]] = 0
            yield [own[a : a + step], np.zeros(len(part), np.int64), *(d @ groups).T.copy()]

    names = [f"d{k}_{c}" for k in ks for c in range(k)]
    rows = named.select("id", code.alias("apart"), "v")
    total = _meet(rows, ["v"], each, [(x, pa.float64()) for x in names], unit_rows=False, merge=sums_of).groupBy("source").agg(*(F.sum(x).alias(x) for x in names))
    j = total.join(named.select(F.col("id").alias("source"), *(f"c{k}" for k in ks)), "source")
    out = []
    for k in ks:
        counts = [size[k].get(c, 0) for c in range(k)]
        mean = F.array(*(F.col(f"d{k}_{c}") / F.lit(float(counts[c])) if counts[c] else F.lit(None).cast("double") for c in range(k)))
        rows_in = F.element_at(F.array(*(F.lit(float(c)) for c in counts)), (F.col(f"c{k}") + 1).cast("int"))
        inner = F.element_at(F.array(*(F.col(f"d{k}_{c}") for c in range(k))), (F.col(f"c{k}") + 1).cast("int")) / F.when(rows_in > 1, rows_in - 1)
        own = F.col(f"c{k}")
        outer = F.array_min(F.filter(mean, lambda x, i: (i != own) & x.isNotNull()))  # noqa: B023
        out.append(F.avg(F.coalesce(F.try_divide(outer - inner, F.greatest(inner, outer)), F.lit(0.0))).alias(f"s{k}"))
    row = j.agg(*out).first()
    return {k: row[f"s{k}"] for k in ks}
