"""Relational helpers with deterministic ties: ranking, de-duplication, shares, pairs, column resolution."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.storage import materialize


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing."""
    return df.select(*(F.nanvl(c, F.lit(None)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must be total."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key, the first of a total order (give a descending one to keep the last)."""
    return top_n_per_group(df, keys, order, 1, "_first").drop("_first")


def mode_with_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each group's commonest value (ties to the smaller), its count and share."""
    c = df.where(F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return c.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias("mode"), F.max("n").alias("mode_count"), (F.max("n") / F.sum("n")).alias("mode_share"))


def avg_pct_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank / n with tied ranks averaged, nulls left out of the ranking.

    Ranks come from cumulative counts of distinct values that are sorted by range, so no task holds all rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranked = cumulative(counts, "_v", "_c", "_upto")
    total = df.agg(F.count(value).alias("_n"))
    share = ranked.crossJoin(F.broadcast(total)).select("_v", ((F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2) / F.col("_n")).alias(out))
    return df.join(share, F.col(value) == F.col("_v"), "left").drop("_v")


def cumulative(df: DataFrame, key: str, amount: str, out: str) -> DataFrame:
    """Running sum of ``amount`` in the order of ``key``: sorted by range, then each range's total is added to the next ones'."""
    ranged = materialize(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part").agg(F.sum(amount).alias("_t"))
    before = totals.withColumn("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "_part").withColumn(out, F.sum(amount).over(w) + F.col("_b")).drop("_part", "_t", "_b")


def global_rank(df: DataFrame, key: Column, out: str = "rank") -> DataFrame:
    """W10 without a limit: 1..n in a total order, ranged instead of through one task."""
    keyed = materialize(df.withColumn("_k", key).repartitionByRange(F.col("_k")).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("_t"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return keyed.join(F.broadcast(before), "_part").withColumn(out, F.row_number().over(Window.partitionBy("_part").orderBy("_k")) + F.col("_b")).drop("_k", "_part", "_t", "_b")


def zscores(df: DataFrame, cols: Iterable[str], impute: bool = False) -> DataFrame:
    """Population z-scores; constant columns give 0. ``impute``: missing values become the exact median first.

    Two one-row aggregates are broadcast; no window runs over the whole table.
    """
    cols = list(cols)
    if impute:
        med = df.agg(*(F.median(c).alias(f"_m_{c}") for c in cols))
        df = df.crossJoin(F.broadcast(med)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in cols}).drop(*(f"_m_{c}" for c in cols))
    stats = df.agg(*(F.avg(c).alias(f"_a_{c}") for c in cols), *(F.stddev_pop(c).alias(f"_s_{c}") for c in cols))
    z = lambda c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.crossJoin(F.broadcast(stats)).withColumns({c: z(c) for c in cols}).drop(*(f"_{k}_{c}" for k in "as" for c in cols))


def min_max(df: DataFrame, c: str, out: str) -> DataFrame:
    """to [0, 1]; a constant or empty column gives 0.5."""
    s = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    return df.crossJoin(F.broadcast(s)).withColumn(out, F.coalesce(F.try_divide(F.col(c) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.5))).drop("_lo", "_hi")


def normalise_name(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def resolve_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """Exact, then normalised, then with a join suffix, then by all words of a candidate. Runs at plan time."""
    for c in candidates:
        if c in columns:
            return c
    plain = {normalise_name(c): c for c in reversed(columns)}
    for c in candidates:
        if normalise_name(c) in plain:
            return plain[normalise_name(c)]
    for c in candidates:
        for end in ("_x", "_y"):
            if c + end in columns:
                return c + end
    for c in candidates:
        words = set(re.split("[^a-z0-9]+", c.lower())) - {""}
        for have in columns:
            if words and words <= set(re.split("[^a-z0-9]+", have.lower())):
                return have
    return None


def append_features(left: DataFrame, right: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Left join of the new columns by the first key set that both tables have; unchanged if there is none."""
    keys = next((list(k) for k in key_sets if set(k) <= set(left.columns) and set(k) <= set(right.columns)), None)
    if keys is None:
        return left
    new = [c for c in right.columns if c not in left.columns]
    return left.join(first_by(right.select(*keys, *new), keys, *(F.col(c).asc_nulls_last() for c in new)) if new else right.select(*keys).distinct(), keys, "left")
