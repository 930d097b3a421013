"""Recommendations by similarity views: options, lookup of a name, model summary, and a command line over them."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators.contracts import ContractError
from tessera.operators.tables import top_n_per_group


class NotFound(ContractError):
    """No entity has this name."""


class Ambiguous(ContractError):
    """Several entities have this name."""


def find_one(df: DataFrame, id_: str, name: str, wanted: str):
    """V7: the id of the one row whose trimmed name equals ``wanted`` in any case."""
    found = df.where(F.lower(F.trim(F.col(name))) == wanted.strip().lower()).select(id_).distinct().orderBy(id_).limit(6).collect()
    if not found:
        raise NotFound(f"no entity is named {wanted!r}")
    if len(found) > 1:
        raise Ambiguous(f"{wanted!r} names {', '.join(str(r[0]) for r in found[:5])}{' and more' if len(found) > 5 else ''}")
    return found[0][0]


def recommend(pairs: DataFrame, model: str, top_n: int = 10, sources: Sequence | None = None, attributes: DataFrame | None = None, id_: str = "id", same: str | None = None, apart: str | None = None, least: float | None = None) -> DataFrame:
    """(source, target, score, rank) from a table of pairs (source, target, one column a model).

    ``same`` and ``apart`` name columns of ``attributes`` that both ends must share, or must not; rows without a value
    match nothing. ``sources``: only these (none of them with a partner is an error), else all at once.
    """
    if top_n < 1:
        raise ContractError("top_n must be 1 or more")
    if model not in pairs.columns:
        raise ContractError(f"no model named {model}")
    p = pairs.where(F.col(model).isNotNull())
    if sources is not None:
        p = p.where(F.col("source").isin(list(sources)))
    if same or apart:
        cols = [c for c in dict.fromkeys((same, apart)) if c]
        side = lambda end: attributes.select(F.col(id_).alias(end), *(F.col(c).alias(f"_{end}_{c}") for c in cols))
        p = p.join(side("source"), "source").join(side("target"), "target")
        if same:
            p = p.where(F.col(f"_source_{same}") == F.col(f"_target_{same}"))
        if apart:
            p = p.where(F.col(f"_source_{apart}") != F.col(f"_target_{apart}"))
    if least is not None:
        p = p.where(F.col(model) >= least)
    out = top_n_per_group(p.select("source", "target", F.col(model).alias("score")), ["source"], [F.desc("score"), F.col("target")], top_n)
    if sources is not None and not out.limit(1).count():
        raise ContractError("no recommendation is left under these options")
    return out


def feature_manifest(df: DataFrame, views: dict[str, Sequence[str]]) -> DataFrame:
    """V6: (view, feature, rows, with_value, coverage, distinct) of each view's features, in one pass."""
    names = [(v, c) for v, cols in views.items() for c in cols]
    row = df.agg(F.count("*").alias("rows"), *(F.count(c).alias(f"n{i}") for i, (_, c) in enumerate(names)), *(F.countDistinct(c).alias(f"d{i}") for i, (_, c) in enumerate(names)))
    listed = F.array(*(F.struct(F.lit(v).alias("view"), F.lit(c).alias("feature"), F.col(f"n{i}").alias("with_value"), F.col(f"d{i}").alias("distinct")) for i, (v, c) in enumerate(names)))
    out = row.select("rows", F.explode(listed).alias("f")).select("f.view", "f.feature", "rows", "f.with_value", "f.distinct")
    return out.withColumn("coverage", F.round(F.try_divide(F.col("with_value"), F.col("rows")), 6))


def model_summary(pairs: DataFrame, models: Sequence[str], entities: DataFrame, key: str) -> DataFrame:
    """V6: (model, entities, pairs, coverage, mean_score, best): which of the n * (n - 1) directed pairs a model scores."""
    each = pairs.groupBy("source").agg(*(f(c).alias(f"{k}_{c}") for c in models for k, f in (("pairs", F.count), ("sum", F.sum), ("best", F.max))))
    return summary_of_totals(each, models, entities, key)


def summary_of_totals(totals: DataFrame, models: Sequence[str], entities: DataFrame, key: str) -> DataFrame:
    """V6 from (source, pairs_<model>, sum_<model>, best_<model>), any number of rows a source."""
    n = entities.agg(F.countDistinct(key).alias("_n"))
    each = totals.groupBy("source").agg(*(f(f"{k}_{c}").alias(f"{k}_{c}") for c in models for k, f in (("pairs", F.sum), ("sum", F.sum), ("best", F.max))))
    row = each.agg(*(x.alias(f"{k}{i}") for i, c in enumerate(models) for k, x in (("e", F.count_if((F.col(f"pairs_{c}") > 0) & F.col("source").isNotNull())), ("n", F.coalesce(F.sum(f"pairs_{c}"), F.lit(0)).cast("long")), ("s", F.sum(f"sum_{c}")), ("b", F.max(f"best_{c}")))))
    listed: Column = F.array(*(F.struct(F.lit(c).alias("model"), F.col(f"e{i}").alias("entities"), F.col(f"n{i}").alias("pairs"), F.try_divide(f"s{i}", f"n{i}").alias("mean_score"), F.col(f"b{i}").alias("best")) for i, c in enumerate(models)))
    out = row.crossJoin(F.broadcast(n)).select("_n", F.explode(listed).alias("s")).select("s.*", "_n")
    return out.select("model", "entities", "pairs", F.round(F.try_divide(F.col("pairs"), F.col("_n") * (F.col("_n") - 1)), 6).alias("coverage"), F.round("mean_score", 6).alias("mean_score"), F.round("best", 6).alias("best"))


def parser() -> argparse.ArgumentParser:
    """The options of ``python -m tessera.operators.recommend``."""
    p = argparse.ArgumentParser(prog="recommend", description="Recommendations from a table of entities and one of similarity pairs.")
    p.add_argument("--entities", required=True, help="Parquet: id, name and the columns of --same and --apart")
    p.add_argument("--pairs", required=True, help="Parquet: source, target, one column a model")
    p.add_argument("--name", help="one entity, by its name")
    p.add_argument("--model", default="hybrid")
    p.add_argument("--top-n", type=int, default=10)
    p.add_argument("--list", action="store_true", help="list the names")
    p.add_argument("--all", action="store_true", help="recommend for all entities")
    p.add_argument("--same", help="column that both must share")
    p.add_argument("--apart", help="column that must differ")
    p.add_argument("--min-score", type=float)
    p.add_argument("--save", help="write Parquet here instead of showing the rows")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    options = parser().parse_args(argv)
    if sum((options.list, options.all, options.name is not None)) != 1:
        parser().error("give one of --name, --all and --list")
    if options.top_n < 1:
        parser().error("--top-n must be 1 or more")
    spark = spark or SparkSession.builder.getOrCreate()
    entities, pairs = spark.read.parquet(options.entities), spark.read.parquet(options.pairs)
    if options.list:
        out = entities.select("name").distinct().orderBy("name")
    else:
        sources = None if options.all else [find_one(entities, "id", "name", options.name)]
        out = recommend(pairs, options.model, options.top_n, sources, entities, "id", options.same, options.apart, options.min_score)
        names = entities.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
        out = out.join(names, "target", "left").select("source", "rank", "target", "target_name", "score").orderBy("source", "rank")
    if options.save:
        out.write.mode("overwrite").parquet(options.save)
    else:
        out.show(1000, truncate=False)
    return out


if __name__ == "__main__":
    main()
