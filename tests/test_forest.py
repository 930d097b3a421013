"""Extra trees against a plain recursion with the same draws; folds in the same passes; held-out accuracy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import forest as E

RNG = np.random.default_rng(1)


def rows(n=120, width=5):
    y = RNG.integers(0, 3, n)
    x = RNG.normal(0, 1, (n, width)) + y[:, None] * np.array([2.5, 0, 1.0, 0, 0])
    x[:, 4] = 1.0  # never varies
    x[:, 3] = np.round(x[:, 3])  # ties
    x[5] = x[6]
    w = np.where(y == 2, 2.0, 1.0)
    return x, y, w, np.arange(n) % 3


def table(spark, x, y, w, fold):
    return spark.createDataFrame([(i, v.tolist(), int(a), float(b), int(c)) for i, (v, a, b, c) in enumerate(zip(x, y, w, fold, strict=True))], "id long, v array<double>, _y int, _w double, fold int").withColumn("_f", array_to_vector("v"))


def gini(w, y):
    total = w.sum()
    return total - sum(w[y == c].sum() ** 2 for c in range(3)) / total if total else 0.0


def plain(x, y, w, number, depth, least, seed):
    """A tree as a function from a row to class shares; nodes numbered level by level in the order of their parents."""
    nodes, at, level = {0: np.arange(len(x))}, 1, [0]
    splits = {}
    for _ in range(depth):
        following = []
        for n in level:
            i = nodes[n]
            if len(i) < 2 * least or len(set(y[i])) < 2:
                continue
            order, place = E.draws(seed, number, n, x.shape[1])
            vary = [f for f in order if x[i, f].min() < x[i, f].max()][: int(np.sqrt(x.shape[1]))]
            best = None
            for f in vary:
                low, high = x[i, f].min(), x[i, f].max()
                cut = low + place[f] * (high - low)
                a, b = i[x[i, f] <= cut], i[x[i, f] > cut]
                if min(len(a), len(b)) < least:
                    continue
                fall = gini(w[i], y[i]) - gini(w[a], y[a]) - gini(w[b], y[b])
                if best is None or fall > best[0] + 1e-12:
                    best = fall, f, cut, a, b
            if best:
                splits[n] = best[1], best[2], at, at + 1
                nodes[at], nodes[at + 1] = best[3], best[4]
                following += [at, at + 1]
                at += 2
        level = following

    def shares(row):
        n = 0
        while n in splits:
            f, cut, left, right = splits[n]
            n = left if row[f] <= cut else right
        i = nodes[n]
        return np.array([w[i][y[i] == c].sum() for c in range(3)]) / w[i].sum()

    return shares


def test_as_by_plain_recursion_in_every_fold(spark, monkeypatch):
    monkeypatch.setattr(E, "CELLS", 200)  # the open nodes need many passes
    x, y, w, fold = rows()
    models = E.ExtraTrees(trees=3, depth=4, seed=9).fit_folds(table(spark, x, y, w, fold).repartition(4), 3)
    for k, model in enumerate(models):
        got = {r.id: np.array(r.probability.toArray()) for r in model.transform(table(spark, x, y, w, fold)).collect()}
        on = fold != k
        trees = [plain(x[on], y[on], w[on], t, 4, 2, 9) for t in range(3)]
        for i in range(len(x)):
            assert np.allclose(got[i], np.mean([t(x[i]) for t in trees], axis=0)), (k, i)


def test_one_model_and_held_out_rows(spark):
    x, y, w, fold = rows(300)
    d = table(spark, x, y, w, fold)
    out = E.ExtraTrees(trees=20, depth=6).fit(d.where("fold <> 0")).transform(d.where("fold = 0"))
    assert out.where(F.col("prediction") == F.col("_y")).count() / out.count() > 0.8
    assert {c for c in out.columns} == {*d.columns, "probability", "prediction"}


def test_few_rows(spark):
    d = table(spark, np.ones((3, 2)), np.array([0, 1, 1]), np.ones(3), np.zeros(3, int))
    got = E.ExtraTrees(trees=2).fit(d).transform(d).collect()
    assert all(np.allclose(r.probability.toArray(), [1 / 3, 2 / 3]) and r.prediction == 1 for r in got)
    with pytest.raises(ValueError):
        E.ExtraTrees(trees=1).fit(d.limit(0))
