"""M2: extra trees, grown level by level over the whole table.

A tree is grown on all rows. At a node the features stand in an order drawn for the node; of each of the first sqrt(all)
that vary there a threshold is drawn between its least and greatest value; the split of the largest fall of the weighted
Gini impurity is taken. A level costs two passes: one for the extremes of every feature at the open nodes, one for the
class weights on either side of the drawn thresholds. All trees of all folds grow in the same passes: a fold's trees
leave its own rows out. Tasks add up arrays of CELLS numbers at most and send one row a cell; Spark adds those; the
driver sees sums by node only. More open nodes than that take more passes.

The draws depend on the seed, the tree and the node alone, so the trees do not depend on how the rows are dealt.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tessera.storage import materialize, scratch

CELLS = 1 << 17


def draws(seed: int, tree: int, node: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the features at a node, and for each of them a place in [0, 1) between its extremes."""
    r = np.random.default_rng([seed, tree, node])
    return r.permutation(features), r.random(features)


def impurity(weights: np.ndarray) -> np.ndarray:
    """Weighted Gini impurity: total weight less the squares' share; the last axis are the classes."""
    total = weights.sum(-1)
    return total - np.divide((weights * weights).sum(-1), total, out=np.zeros_like(total), where=total > 0)


class Tree:
    """A growing tree as parallel lists; a leaf's feature is -1. ``without``: the fold whose rows it does not see."""

    def __init__(self, number: int, without: int | None):
        self.number, self.without = number, without
        self.feature, self.threshold, self.left, self.right, self.classes = [-1], [0.0], [0], [0], [None]
        self.open = [0]

    def split(self, node: int, feature: int, threshold: float, sides) -> None:
        at = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, at, at + 1
        for side in sides:
            for values, x in zip((self.feature, self.threshold, self.left, self.right, self.classes), (-1, 0.0, 0, 0, side), strict=True):
                values.append(x)

    def arrays(self) -> tuple:
        return np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right)


def route(arrays: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    feature, threshold, left, right = arrays
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        f = feature[at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        at[rows] = np.where(x[rows, f] <= threshold[at[rows]], left[at[rows]], right[at[rows]])
    return at


def _columns(batch: pa.RecordBatch, features: int) -> tuple:
    c = dict(zip(batch.schema.names, batch.columns, strict=True))
    x = c["f"].flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
    return x, c["y"].to_numpy(zero_copy_only=False), c["w"].to_numpy(zero_copy_only=False), c["fold"].to_numpy(zero_copy_only=False)


def _sums(rows: DataFrame, part: list, features: int, width: int, start, add, merge) -> np.ndarray:
    """Arrays (nodes, width) of sums or extremes over all rows, for the open nodes of ``part``: (tree, its nodes)."""
    first = list(itertools.accumulate((len(nodes) for _, nodes in part), initial=0))
    sent = [(t.without, t.arrays(), np.array(nodes), at) for (t, nodes), at in zip(part, first, strict=False)]
    total = first[-1]

    def run(batches):
        out = start(total)
        for batch in batches:
            x, y, w, fold = _columns(batch, features)
            for without, arrays, nodes, at in sent:
                seen = slice(None) if without is None else fold != without
                xs = x[seen]
                leaf = route(arrays, xs)
                place = np.searchsorted(nodes, leaf)
                here = np.flatnonzero(nodes[np.minimum(place, len(nodes) - 1)] == leaf)
                if len(here):
                    add(out, at + place[here], xs[here], y[seen][here], w[seen][here])
        flat = out.reshape(-1)
        told = np.flatnonzero(flat != start(1).reshape(-1)[np.arange(len(flat)) % width])
        for a in range(0, len(told), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(told[a : a + 10_000]), pa.array(flat[told[a : a + 10_000]])], ["cell", "v"])

    got = rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(merge("v").alias("v")).toArrow()
    flat = start(total).reshape(-1)
    flat[got["cell"].to_numpy()] = got["v"].to_numpy()
    return flat.reshape(total, width)


def _parts(trees: list[Tree], nodes: int):
    """The open nodes, at most ``nodes`` at a time, as lists of (tree, nodes in order)."""
    each = ((t, n) for t in trees for n in sorted(t.open))
    while held := list(itertools.islice(each, nodes)):
        yield [(t, [n for _, n in group]) for t, group in itertools.groupby(held, key=lambda e: e[0])]


def grow(rows: DataFrame, features: int, classes: int, trees: list[Tree], depth: int, least: int, seed: int) -> None:
    """Grows ``trees`` on rows (f array<double> without nulls, y int, w double, fold int)."""
    tried = max(1, int(np.sqrt(features)))
    # A cell of the second pass: by drawn threshold the weights and numbers of the left side, then those of the node.
    wide = (tried + 1) * (classes + 1)
    for level in range(depth + 1):
        grown: list = []
        for part in _parts(trees, max(1, CELLS // max(2 * features, wide))):
            keys = [(t, n) for t, nodes in part for n in nodes]

            def extremes(total):
                return np.full((total, 2 * features), np.inf)

            def widen(out, place, x, y, w):
                order = np.argsort(place, kind="stable")
                at = place[order]
                begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                both = np.concatenate([x[order], -x[order]], axis=1)
                out[at[begin]] = np.minimum(out[at[begin]], np.minimum.reduceat(both, begin, axis=0))

            ends = _sums(rows, part, features, 2 * features, extremes, widen, F.min)
            low, high = ends[:, :features], -ends[:, features:]
            which, cuts = np.full((len(keys), tried), -1), np.zeros((len(keys), tried))
            for i, (t, n) in enumerate(keys):
                order, place = draws(seed, t.number, n, features)
                vary = [f for f in order if low[i, f] < high[i, f]][:tried]
                which[i, : len(vary)] = vary
                # A drawn place may round up to the greatest value, which would leave the right side empty.
                cuts[i, : len(vary)] = [min(low[i, f] + place[f] * (high[i, f] - low[i, f]), np.nextafter(high[i, f], low[i, f])) for f in vary]

            def nothing(total):
                return np.zeros((total, wide))

            def weigh(out, place, x, y, w, which=which, cuts=cuts):
                m = len(out) * (classes + 1)
                for k in range(tried + 1):
                    on = np.ones(len(place), bool)
                    if k < tried:
                        f = which[place, k]
                        on = (f >= 0) & (x[np.arange(len(x)), f] <= cuts[place, k])
                    p, v = place[on] * (classes + 1), w[on]
                    sums = np.bincount(p + y[on], v, m) + np.bincount(p + classes, minlength=m)
                    out[:, k * (classes + 1) : (k + 1) * (classes + 1)] += sums.reshape(-1, classes + 1)

            found = _sums(rows, part, features, wide, nothing, weigh, F.sum).reshape(len(keys), tried + 1, classes + 1)
            for (t, n), f, cut, sums in zip(keys, which, cuts, found, strict=True):
                whole = sums[-1]
                t.classes[n] = whole[:classes]
                if level == depth or whole[-1] < 2 * least or (whole[:classes] > 0).sum() < 2:
                    continue
                left, right = sums[:-1], whole - sums[:-1]
                fall = impurity(whole[:classes]) - impurity(left[:, :classes]) - impurity(np.maximum(right[:, :classes], 0))
                fall[(f < 0) | (left[:, -1] < least) | (right[:, -1] < least)] = -np.inf
                best = int(fall.argmax())
                if np.isfinite(fall[best]):
                    grown.append((t, n, int(f[best]), float(cut[best]), (left[best, :classes], np.maximum(right[best, :classes], 0))))
        for t in trees:
            t.open = []
        for t, n, f, cut, sides in grown:
            t.split(n, f, cut, sides)
            t.open += [t.left[n], t.right[n]]
        if not grown:
            return


class ExtraTrees(Estimator):
    """Columns ``_f`` (vector), ``_y`` (class number), ``_w`` (weight); for ``fit_folds`` also ``fold``. Nulls and NaN
    in the features are an error of the caller's; rows of weight 0 count only among a leaf's least rows."""

    def __init__(self, trees: int = 60, depth: int = 10, least: int = 2, seed: int = 42):
        super().__init__()
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed

    def _grown(self, data: DataFrame, folds: list[int | None]) -> list[ExtraTreesModel]:
        size = data.agg(F.max(F.size(vector_to_array("_f"))), F.max("_y")).first()
        if size[0] is None:
            raise ValueError("extra trees need rows")
        fold = F.col("fold").cast("int") if "fold" in data.columns else F.lit(0)
        rows = data.select(vector_to_array("_f").alias("f"), F.col("_y").cast("int").alias("y"), F.col("_w").cast("double").alias("w"), fold.alias("fold"))
        classes = int(size[1]) + 1
        trees = [Tree(k, without) for without in folds for k in range(self.trees)]
        with scratch(data.sparkSession):
            grow(materialize(rows, "rows"), size[0], classes, trees, self.depth, self.least, self.seed)
        return [ExtraTreesModel(trees[i * self.trees : (i + 1) * self.trees], size[0], classes) for i in range(len(folds))]

    def _fit(self, data: DataFrame) -> ExtraTreesModel:
        return self._grown(data, [None])[0]

    def fit_folds(self, data: DataFrame, folds: int) -> list[ExtraTreesModel]:
        """One model a fold, trained on the other folds' rows, all in the same passes."""
        return self._grown(data, list(range(folds)))


class ExtraTreesModel(Model):
    """Adds ``probability`` (the mean of the trees' leaf shares) and ``prediction`` (the first largest)."""

    def __init__(self, trees: list[Tree], features: int, classes: int):
        super().__init__()
        self.features, self.classes = features, classes
        shares = [np.array([c if f < 0 else np.zeros(classes) for f, c in zip(t.feature, t.classes, strict=True)]) for t in trees]
        self.trees = [(t.arrays(), s / np.maximum(s.sum(1, keepdims=True), 1e-300)) for t, s in zip(trees, shares, strict=True)]

    def _transform(self, data: DataFrame) -> DataFrame:
        spark, features = data.sparkSession, self.features
        held = spark.sparkContext.broadcast(self.trees)  # at most trees * 2 ** (depth + 1) nodes

        @F.pandas_udf("array<double>")
        def probabilities(f):
            import pandas as pd

            x = np.stack(f.to_numpy()) if len(f) else np.zeros((0, features))
            p = sum(shares[route(arrays, x)] for arrays, shares in held.value) / len(held.value)
            return pd.Series(list(p))

        out = data.withColumn("_p", probabilities(vector_to_array("_f")))
        largest = F.array_position("_p", F.array_max("_p")) - 1
        return out.withColumn("prediction", largest.cast("double")).withColumn("probability", array_to_vector("_p")).drop("_p")
