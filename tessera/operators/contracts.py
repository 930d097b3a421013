"""Contracts on tables: what must hold, checked in one aggregation each."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


class ContractError(ValueError):
    """A table does not hold what it promises."""


def require_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """D1."""
    if missing := sorted(set(wanted) - set(df.columns)):
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def select_present(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The wanted columns that exist, each once, in the order asked for."""
    return df.select(*dict.fromkeys(c for c in wanted if c in df.columns))


def pair_table(pairs: DataFrame, entities: DataFrame, key: str, source: str = "source", target: str = "target") -> DataFrame:
    """One row (pairs_off, self_pairs, repeated_pairs) of a table of ordered pairs: how far it is from n * (n - 1)
    rows, the pairs of a thing with itself, and the rows beyond the first of a pair. All are 0 in a whole table."""
    each = pairs.groupBy(source, target).agg(F.count("*").alias("_c"))
    return pair_totals(each.select(F.col("_c").alias("rows"), (F.col(source) == F.col(target)).cast("long").alias("self_pairs"), (F.col("_c") - 1).alias("repeated_pairs")), entities, key)


def pair_totals(counts: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """D9 from counts (rows, self_pairs, repeated_pairs) of the parts of a table of pairs, where a pair has one part."""
    n = entities.agg(F.countDistinct(key).alias("_n"))
    found = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "self_pairs", "repeated_pairs")))
    return found.crossJoin(F.broadcast(n)).select(F.abs(F.col("rows") - F.col("_n") * (F.col("_n") - 1)).alias("pairs_off"), "self_pairs", "repeated_pairs")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """D3: the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def checked_left_join(left: DataFrame, right: DataFrame, keys: list[str], one_to_one: bool = False) -> DataFrame:
    """A left join whose right side (for one_to_one also the left) must hold each key once."""
    for side, name in ((right, "right"), (left, "left"))[: 1 + one_to_one]:
        if duplicate_keys(side.where(" and ".join(f"`{k}` is not null" for k in keys)), *keys).limit(1).count():
            raise ContractError(f"the {name} side repeats keys {keys}")
    return left.join(right, keys, "left")


def out_of_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(column, violations), all columns in one pass; nulls and NaN do not count."""
    row = df.agg(*(F.count_if((F.col(c) < lo) | (F.nanvl(F.col(c).cast("double"), F.lit(None)) > hi)).alias(c) for c, (lo, hi) in bounds.items()))
    return row.unpivot([], list(bounds), "column", "violations")


def disagreements(left: DataFrame, right: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """(column, mismatches) of shared columns, compared as text where both are set."""
    both = left.select(key, *(F.col(c).cast("string").alias(f"l_{c}") for c in shared)).join(right.select(key, *(F.col(c).cast("string").alias(f"r_{c}") for c in shared)), key)
    row = both.agg(*(F.count_if(F.col(f"l_{c}") != F.col(f"r_{c}")).alias(c) for c in shared))
    return row.unpivot([], shared, "column", "mismatches")


def status(passed: Column, warn_only: bool = False) -> Column:
    """D7."""
    return F.when(passed, "passed").otherwise("warning" if warn_only else "failed")


def enforce(checks: DataFrame) -> DataFrame:
    """Raises if a row of (check, status) failed."""
    if failed := [r["check"] for r in checks.where("status = 'failed'").select("check").limit(100).collect()]:
        raise ContractError(f"failed: {', '.join(failed)}")
    return checks


def keys_preserved(base: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """One row: rows of both, keys lost and keys added."""
    lost, added = base.join(built, key, "left_anti"), built.join(base, key, "left_anti")
    return base.agg(F.count("*").alias("base_rows")).crossJoin(built.agg(F.count("*").alias("built_rows"))).crossJoin(lost.agg(F.count("*").alias("lost"))).crossJoin(added.agg(F.count("*").alias("added")))


def coverage_class(first: Column, second: Column, names: tuple[str, str]) -> Column:
    """D8, P7."""
    a, b = names
    return F.when(first & second, f"{a}_and_{b}").when(first, f"{a}_only").when(second, f"{b}_only").otherwise("metadata_only")


def usable_features(df: DataFrame, candidates: Iterable[str], least: int = 3) -> list[str]:
    """Existing columns with ``least`` values or more and at least two distinct ones; one pass."""
    names = [c for c in dict.fromkeys(candidates) if c in df.columns]
    if not names:
        return []
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in names}
    row = df.agg(*(F.count(x).alias(f"n_{c}") for c, x in clean.items()), *(F.min(x).alias(f"a_{c}") for c, x in clean.items()), *(F.max(x).alias(f"b_{c}") for c, x in clean.items())).first()
    return [c for c in names if row[f"n_{c}"] >= least and row[f"a_{c}"] != row[f"b_{c}"]]


def no_leakage(features: Iterable[str], forbidden: Iterable[str]) -> None:
    """D11."""
    if bad := sorted(set(features) & set(forbidden)):
        raise ContractError(f"features give the label away: {', '.join(bad)}")


def classes_large_enough(df: DataFrame, label: str, folds: int) -> None:
    """D11."""
    if small := [r[0] for r in df.groupBy(label).count().where(F.col("count") < folds).limit(50).collect()]:
        raise ContractError(f"classes with fewer than {folds} rows: {small}")


def expect_count(df: DataFrame, expected: int, what: str) -> DataFrame:
    """D12."""
    if (n := df.count()) != expected:
        raise ContractError(f"{what}: {n}, expected {expected}")
    return df
