"""Supervised models over a feature table: balanced weights, stratified folds, out-of-fold predictions, explanations."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.contracts import classes_large_enough, no_leakage
from tessera.operators.forest import ExtraTrees
from tessera.operators.tables import avg_pct_rank, global_rank, zscores
from tessera.storage import contained, materialize


def models(rows: int) -> dict[str, Callable]:
    """M2: the classifiers by name. A linear SVM's probabilities are a softmax of its margins."""
    common = {"featuresCol": "_f", "labelCol": "_y", "weightCol": "_w"}
    return {
        "logistic": lambda: LogisticRegression(family="multinomial", regParam=1 / (0.5 * rows), maxIter=50, **common),
        "random_forest": lambda: RandomForestClassifier(numTrees=60, featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=42, **common),
        "extra_trees": lambda: ExtraTrees(trees=60, depth=10, least=2, seed=42),
        "linear_svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.1), parallelism=4, featuresCol="_f", labelCol="_y", weightCol="_w"),
        "tree": lambda: DecisionTreeClassifier(maxDepth=4, minInstancesPerNode=4, **common),
    }


def prepare(df: DataFrame, id_: str, label: str, features: list[str], folds: int = 5, repeat: int = 0) -> tuple[DataFrame, list[str]]:
    """Z-scored features, class numbers, balanced weights n / (k * n_c), and a stratified fold by hash order."""
    no_leakage(features, [label, id_])
    df = df.where(F.col(label).isNotNull())
    classes_large_enough(df, label, folds)
    z = zscores(df.select(F.col(id_).alias("id"), F.col(label).cast("string").alias("label"), *features), features, impute=True)
    index = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(z)
    size = z.groupBy("label").agg(F.count("*").alias("_nc"))
    total = size.agg(F.sum("_nc").alias("_n"), F.count("*").alias("_k"))
    w = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(repeat)), "id")
    out = index.transform(z).join(F.broadcast(size), "label").crossJoin(F.broadcast(total))
    out = out.withColumn("_w", F.col("_n") / (F.col("_k") * F.col("_nc"))).withColumn("fold", (F.row_number().over(w) - 1) % folds)
    out = VectorAssembler(inputCols=features, outputCol="_f").transform(out).drop("_nc", "_n", "_k")
    return out, list(index.labels)


def out_of_fold(data: DataFrame, classes: list[str], model: Callable, folds: int) -> DataFrame:
    """M5: (id, fold, actual, predicted, correct, confidence, margin, top_2_correct, probabilities)."""
    parts, estimator = [], model()
    together = estimator.fit_folds(data, folds) if hasattr(estimator, "fit_folds") else None
    for k in range(folds):
        fitted = together[k] if together else Pipeline(stages=[estimator]).fit(data.where(F.col("fold") != k))
        scored = fitted.transform(data.where(F.col("fold") == k))
        if "probability" in scored.columns:
            p = vector_to_array("probability")
        else:
            raw = F.transform(vector_to_array("rawPrediction"), F.exp)
            p = F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y))
        parts.append(scored.select("id", "fold", F.col("label").alias("actual"), "_y", F.col("prediction").cast("int").alias("_p"), p.alias("p")))
    names = F.array(*map(F.lit, classes))
    ranked = F.sort_array(F.transform("p", lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))), asc=False)
    out = reduce(DataFrame.unionByName, parts).withColumn("_r", ranked)
    return out.select(
        "id", "fold", "actual", F.element_at(names, F.col("_p") + 1).alias("predicted"), (F.col("_y") == F.col("_p")).alias("correct"), F.element_at("p", F.col("_p") + 1).alias("confidence"),
        (F.col("_r")[0]["p"] - F.col("_r")[1]["p"]).alias("margin"), ((F.col("_y") == -F.col("_r")[0]["i"]) | (F.col("_y") == -F.col("_r")[1]["i"])).alias("top_2_correct"),
        F.map_from_arrays(names, "p").alias("probabilities"),
    )


def ranked_errors(predictions: DataFrame, n: int = 20) -> DataFrame:
    """M9: the wrong predictions made with the most confidence (ties to the smaller id), ranked."""
    wrong = predictions.where(~F.col("correct")).orderBy(F.desc("confidence"), "id").limit(n)
    w = Window.orderBy(F.desc("confidence"), "id")  # n rows
    return wrong.select(F.row_number().over(w).alias("rank"), "id", "fold", "actual", "predicted", "confidence", "margin", "top_2_correct")


def confusion(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """All classes on both sides."""
    c = predictions.groupBy("actual").pivot("predicted", classes).count()
    every = predictions.sparkSession.createDataFrame([(x,) for x in classes], "actual string")
    return every.join(c, "actual", "left").na.fill(0)


def metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M6: accuracy, balanced accuracy, macro F1 and the majority baseline, by hand from the counts: one row, or one for
    each value of the columns ``by``."""
    by = by or []
    c = predictions.groupBy(*by, "actual", "predicted").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    rows, cols = c.groupBy(*by, F.col("actual").alias("c")).agg(F.sum("n").alias("support"), hit.alias("tp")), c.groupBy(*by, F.col("predicted").alias("c")).agg(F.sum("n").alias("guessed"))
    j = rows.join(cols, [*by, "c"], "full").select(*by, *(F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "tp", "guessed")))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("guessed")), F.lit(0.0))
    return j.groupBy(*by).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.try_divide("tp", "support")).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), (F.max("support") / F.sum("support")).alias("majority_baseline"))


@contained
def cross_validate(df: DataFrame, id_: str, label: str, features: list[str], names: list[str], folds: int = 5, repeats: int = 1) -> DataFrame:
    """M4, M7: (model, repeat) rows of metrics with the rank of each model's mean macro F1, balanced accuracy next. What
    makes the features runs once: medians, deviations, class sizes and folds are read off their written table."""
    df = materialize(df.select(id_, label, *features), "features")
    rows, n = [], df.count()
    for r in range(repeats):
        data, classes = prepare(df, id_, label, features, folds, r)
        data = materialize(data, "folds")
        for name in names:
            rows.append(metrics(out_of_fold(data, classes, models(n)[name], folds)).select(F.lit(name).alias("model"), F.lit(r).alias("repeat"), "*"))
    out = reduce(DataFrame.unionByName, rows)
    mean = out.groupBy("model").agg(*(F.avg(c).alias(f"{c}_mean") for c in ("accuracy", "balanced_accuracy", "macro_f1")), *(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in ("accuracy", "balanced_accuracy", "macro_f1")), F.first("majority_baseline").alias("majority_baseline"))
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("macro_f1_mean"), F.desc("balanced_accuracy_mean"), "model")))


def dealt(row: Column, n: int, seed: str) -> Column:
    """The row number (from 0, of ``n``) whose value a row takes: a one-to-one map i -> (a i + b) mod n, a prime to n. The
    rows are numbered in the order of a digest, so that neighbours in the map are not neighbours in the data."""
    draw = random.Random(seed)
    a = next(a for a in iter(lambda: draw.randint(1, max(1, n)), None) if math.gcd(a, n) == 1)
    # The product of two row numbers may pass the longs; decimals hold it.
    return F.pmod(row.cast("decimal(19,0)") * F.lit(a).cast("decimal(19,0)") + F.lit(draw.randrange(n)).cast("decimal(19,0)"), F.lit(n).cast("decimal(19,0)")).cast("long")


@contained
def permutation_importance(data: DataFrame, features: list[str], model: Callable, repeats: int = 30, held_out: int | None = 0) -> DataFrame:
    """M8: fall of macro F1 when a feature's values are dealt anew, ``repeats`` times; on a held-out fold, or on the
    training rows (None). All features and repeats are one job: every row meets, by row number, those that lend it a
    value, and one scoring of all of them ends in counts by (feature, repeat)."""
    fitted = Pipeline(stages=[model()]).fit(data if held_out is None else data.where(F.col("fold") != held_out))
    test = (data if held_out is None else data.where(F.col("fold") == held_out)).drop("_f")
    test = materialize(global_rank(test, F.struct(F.xxhash64("id"), "id"), "_i").withColumn("_i", F.col("_i") - 1), "test")
    n = test.count()
    if not n:
        return data.sparkSession.createDataFrame([], "feature string, importance double, importance_std double")
    assemble = VectorAssembler(inputCols=features, outputCol="_f")
    scored = lambda d, *keys: fitted.transform(assemble.transform(d)).select(*keys, F.col("_y").alias("actual"), F.col("prediction").alias("predicted"))
    base = metrics(scored(test)).first()["macro_f1"]
    turns = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), dealt(F.col("_i"), n, f"{f}/{r}").alias("_from")) for f in features for r in range(repeats)))
    asked = test.select("_y", *features, F.explode(turns).alias("t")).select("_y", *features, "t.*")
    lent = test.select(F.col("_i").alias("_from"), F.struct(*features).alias("_lent"))
    new = {f: F.when(F.col("feature") == f, F.col("_lent")[f]).otherwise(F.col(f)) for f in features}
    falls = metrics(scored(asked.join(lent, "_from").withColumns(new), "feature", "repeat"), ["feature", "repeat"]).select("feature", (F.lit(base) - F.col("macro_f1")).alias("fall"))
    return falls.groupBy("feature").agg(F.avg("fall").alias("importance"), F.coalesce(F.stddev_samp("fall"), F.lit(0.0)).alias("importance_std"))


def coefficients(data: DataFrame, features: list[str], classes: list[str], rows: int) -> DataFrame:
    """(class, feature, coefficient) of the multinomial model; as many rows as classes times features."""
    m = models(rows)["logistic"]().fit(data)
    c = m.coefficientMatrix.toArray()
    return data.sparkSession.createDataFrame([(classes[k], f, float(c[k, j])) for k in range(len(c)) for j, f in enumerate(features)], "class string, feature string, coefficient double")


def global_importance(coef: DataFrame, permuted: DataFrame) -> DataFrame:
    """Mean of the percentile ranks of mean |coefficient| and of permutation importance."""
    m = coef.groupBy("feature").agg(F.avg(F.abs("coefficient")).alias("mean_abs")).join(permuted, "feature")
    m = avg_pct_rank(avg_pct_rank(m, "mean_abs", "_a"), "importance", "_b")
    return m.select("feature", "mean_abs", "importance", ((F.col("_a") + F.col("_b")) / 2).alias("score"))


def tree_rules(data: DataFrame, features: list[str]) -> DataFrame:
    """The shallow tree's rules as text lines with feature names, its depth and leaves."""
    t = models(1)["tree"]().fit(data)
    text = t.toDebugString
    for j in sorted(range(len(features)), reverse=True):
        text = text.replace(f"feature {j} ", f"{features[j]} ")
    rows = [(i, line, t.depth, (t.numNodes + 1) // 2) for i, line in enumerate(text.rstrip().split("\n"))]
    return data.sparkSession.createDataFrame(rows, "line int, rule string, depth int, leaves int")


def contributions(data: DataFrame, coef: DataFrame, features: list[str], predicted: DataFrame, n: int = 8) -> DataFrame:
    """For each row the n strongest terms for (support) and against (oppose) the predicted class, and what most
    moves it to its second class (counterfactual): z * coefficient, z * (second - first)."""
    z = data.select("id", *features).unpivot(["id"], features, "feature", "z")
    ranked = predicted.select("id", F.col("predicted").alias("first"), F.sort_array(F.transform(F.map_entries("probabilities"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("c"))), asc=False).alias("r"))
    ranked = ranked.select("id", "first", F.when(F.col("r")[0]["c"] == F.col("first"), F.col("r")[1]["c"]).otherwise(F.col("r")[0]["c"]).alias("second"))
    one = coef.select(F.col("class").alias("first"), "feature", F.col("coefficient").alias("c1"))
    two = coef.select(F.col("class").alias("second"), "feature", F.col("coefficient").alias("c2"))
    t = z.join(ranked, "id").join(F.broadcast(one), ["first", "feature"]).join(F.broadcast(two), ["second", "feature"])
    t = t.select("id", "first", "second", "feature", (F.col("z") * F.col("c1")).alias("term"), (F.col("z") * (F.col("c2") - F.col("c1"))).alias("move"))
    pick = lambda c, order: F.slice(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("feature"), F.col(c).alias("value")))), 1, n)
    named = lambda a: F.transform(a, lambda x: F.struct(x["feature"].alias("name"), x["value"].alias("value")))
    g = t.groupBy("id", "first", "second").agg(pick("term", -F.col("term")).alias("s"), pick("term", F.col("term")).alias("o"), pick("move", -F.abs("move")).alias("m"))
    return g.select("id", F.col("first").alias("predicted"), "second", named("s").alias("support"), named("o").alias("oppose"), named("m").alias("counterfactual"))
