"""UMAP by tables: graph weights, the curve and the layout against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding as E, umap as U

RNG = np.random.default_rng(3)


def groups(n, width=6, k=3):
    return np.concatenate([RNG.normal(6 * g, 0.5, (n // k, width)) for g in range(k)])


def table(spark, x):
    return spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "id long, v array<double>, row int")


def plain_graph(x, k):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    w = np.zeros((n, n))
    for i in range(n):
        near = sorted((d[i, j], j) for j in range(n) if j != i)[:k]
        least = min((v for v, _ in near if v > 0), default=0.0)
        gaps = np.array([max(0.0, v - least) for v, _ in near])
        low, high = 0.0, 1e6
        for _ in range(200):
            scale = (low + high) / 2
            low, high = (low, scale) if np.exp(-gaps / max(scale, 1e-300)).sum() > math.log2(k) else (scale, high)
        scale = max(scale, 1e-3 * np.mean([v for v, _ in near]))
        for (_, j), gap in zip(near, gaps, strict=True):
            w[i, j] = math.exp(-gap / scale)
    return w + w.T - w * w.T


def test_the_graph_as_by_plain_bisection(spark):
    x = groups(45)
    x[7] = x[8] = x[9]  # copies: neighbours at distance 0
    got = np.zeros((45, 45))
    for r in U.fuzzy_graph(E.nearest(table(spark, x), "id", "v", 8)).collect():
        got[r.a, r.b] = r.w
    assert np.allclose(got, plain_graph(x, 8), atol=1e-6) and np.allclose(got, got.T) and got.max() <= 1


def test_the_curve():
    a, b = U.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.005)


def test_layout_keeps_neighbours(spark):
    x = groups(60)
    odd = spark.createDataFrame([(100, None, 0), (101, [1.0, float("nan")], 0), (None, [1.0] * 6, 0), (3, x[3].tolist(), 1)], "id long, v array<double>, row int")
    found = U.umap(table(spark, x).unionByName(odd), "id", "v", rounds=40)
    got = {r.id: (r.x, r.y) for r in found.collect()}
    assert sorted(got) == [*range(60), 100, 101] and got[100] == got[101] == (None, None)
    y = np.array([got[i] for i in range(60)])
    assert np.isfinite(y).all() and np.allclose(y.mean(0), 0, atol=1e-6)
    near = lambda z: [set(np.argsort(r)[1:11].tolist()) for r in ((z[:, None] - z[None]) ** 2).sum(-1)]
    assert all(j // 20 == i // 20 for i, js in enumerate(near(y)) for j in js)
    kept = np.mean([len(p & q) / 10 for p, q in zip(near(x), near(y), strict=True)])
    assert kept > 0.6  # by chance within the right group: 0.53
    assert len({tuple(r) for r in y.round(9)}) == 60


def test_layout_of_few_and_equal_rows(spark):
    d = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0), (3, None, 0)], "id long, v array<double>, a int").withColumn("x", F.lit(1))
    assert sorted(U.umap(d, "id", "v").collect()) == [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, None, None)]
    assert U.umap(d.limit(0), "id", "v").collect() == []
    same = spark.range(6).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert all(math.isfinite(r.x) and math.isfinite(r.y) for r in U.umap(same, "id", "v", rounds=2).collect())
