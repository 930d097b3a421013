"""Every catalogue query runs, and agrees with DuckDB on the same files where it has SQL."""

import math
import os

import duckdb
import pytest

from tessera import catalog

SLOW = {"cv_model_summary", "oof_predictions", "ranked_errors", "global_importance", "local_explanations", "kmeans_select_k", "tsne_2d", "umap_2d"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name in catalog.SQL:
        r = duck.sql(catalog.SQL[name])
        assert sorted(r.columns) == names
        at = [r.columns.index(c) for c in names]
        assert sorted(map(str, rows)) == sorted(str(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
