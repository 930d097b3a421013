"""Metrics by group, dealt values and permutation importance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import learning as L


def test_metrics_by_group(spark):
    rows = [("a", "x", "x"), ("a", "x", "y"), ("a", "y", "y"), ("b", "x", "x"), ("b", "y", "z")]
    p = spark.createDataFrame(rows, "g string, actual string, predicted string")
    got = {r.g: r for r in L.metrics(p, ["g"]).collect()}
    for g in "ab":
        assert tuple(got[g])[1:] == tuple(L.metrics(p.where(F.col("g") == g)).first())
    assert got["a"].accuracy == pytest.approx(2 / 3) and got["b"].macro_f1 == pytest.approx(1 / 3)


@pytest.mark.parametrize("n", [1, 2, 12, 97])
def test_dealing_is_one_to_one(spark, n):
    d = spark.range(n).select(*(L.dealt(F.col("id"), n, f"s/{k}").alias(f"c{k}") for k in range(3))).toPandas()
    assert all(sorted(d[c]) == list(range(n)) for c in d.columns)
    big = 3_000_000_019
    assert 0 <= spark.range(1).select(L.dealt(F.lit(big - 1), big, "s")).first()[0] < big


def test_importance_finds_the_feature_that_decides(spark):
    r = np.random.default_rng(0)
    rows = [(i, "u" if a > 0 else "v", float(a), float(b)) for i, (a, b) in enumerate(r.normal(0, 1, (90, 2)))]
    data, classes = L.prepare(spark.createDataFrame(rows, "key long, kind string, a double, b double"), "key", "kind", ["a", "b"], 3)
    for name in ("logistic", "extra_trees"):
        got = {x.feature: x for x in L.permutation_importance(data, ["a", "b"], L.models(90)[name], 5).collect()}
        assert got["a"].importance > 0.25 > abs(got["b"].importance) and got["a"].importance_std > 0
    out = L.out_of_fold(data, classes, L.models(90)["extra_trees"], 3)
    assert out.count() == 90 and out.where("correct").count() > 75


def test_features_are_made_once(spark):
    """Every statistic, the folds and the count made the features anew from their texts."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(60).selectExpr("id", "concat('q', id % 2) as label", "cast(id % 7 as double) as x", "cast(id % 2 as double) as y")
    found = L.cross_validate(df.mapInArrow(counted, df.schema), "id", "label", ["x", "y"], ["logistic"], 2).collect()
    assert read.value == 60 and found[0]["accuracy_mean"] == 1.0
