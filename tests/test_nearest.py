"""The k nearest where blocks meet: equal to brute force, and what a block has found bars what it looks at later."""

import numpy as np
import pytest

from tessera.operators import vectors as V


def brute(rows, k, least, apart):
    out = set()
    for i, v, g in rows:
        near = []
        for j, u, h in rows:
            if i != j and None not in (v, u) and (not apart or (g is not None and h is not None and g != h)):
                n = np.linalg.norm(v) * np.linalg.norm(u)
                s = float(V._rounded(np.array([np.dot(v, u) / n if n else 0.0]))[0])
                near += [(-s, j)] if s >= least else []
        out |= {(i, j, -s, r) for r, (s, j) in enumerate(sorted(near)[:k], 1)}
    return out


@pytest.mark.parametrize("apart", [None, "label"])
def test_equal_to_brute_force(spark, monkeypatch, apart):
    monkeypatch.setattr(V, "BLOCK", 30)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(r.normal(size=6), 1)], int(r.integers(3))) for i in range(150)]
    rows += [(200 + i, rows[i % 4][1], [0, 1, None][i % 3]) for i in range(12)] + [(300, None, 1), (301, [0.0] * 6, 2)]  # copies tie
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    for k, least in ((3, 0.3), (5, None)):
        found = {(x.source, x.target, x.similarity, x["rank"]) for x in V.cosine_top_k(df, "id", "v", k, least, apart).collect()}
        assert found == brute(rows, k, -1 if least is None else least, apart)


@pytest.mark.parametrize("apart", [None, "label"])
def test_what_is_held_bars_worse_rows(spark, monkeypatch, apart):
    """Every meeting looked for k rows of its own, though most were worse than those already held."""
    caught = {}
    monkeypatch.setattr(V, "_meet", lambda rows, views, each, fields, **options: caught.update(each=each, **options))
    V._near(spark.createDataFrame([(1, [1.0], 1)], "id long, v array<double>, label int"), "id", "v", 2, None, None, apart)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    r = np.random.default_rng(1)
    x, y = unit(r.normal(size=(40, 8))), unit(r.normal(size=(90, 8)))
    ids, others, labels = np.arange(40), np.arange(100, 190), np.zeros(90, np.int64)
    row = {"ids_a": ids.tobytes(), "ids_b": others.tobytes(), "apart_a": (labels[:40] + 1).tobytes(), "apart_b": labels.tobytes()}
    held = [np.repeat(ids, 2), np.arange(80) + 500, np.repeat([0.9999999] * 39 + [-1.0], 2)]
    found = [np.concatenate(c) for c in zip(*caught["each"](row, [x], [y], held), strict=True)]
    assert caught["bars"] and found[0].tolist() == [39, 39]
    assert set(found[1].tolist()) == set((100 + np.argsort(-(y @ x[39]))[:2]).tolist())
    assert sum(len(c[0]) for c in caught["each"](row, [x], [y], [c[:0] for c in held])) == 80
