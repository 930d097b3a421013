"""Scores that Spark has no function for: fuzzy ratio, match score, musical key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Weights of the match score; tonal profiles and pitch names.
LOOKUP_WEIGHTS = {"title": 0.5, "album": 0.2, "artist": 0.15, "duration": 0.15}
FILE_WEIGHTS = {"title": 0.7, "album": 0.15, "duration": 0.15}
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
PITCHES = "C C# D D# E F F# G G# A A# B".split()


def in_del_ratio(a: str | None, b: str | None) -> float | None:
    """200 * LCS / (len a + len b); 100 for two empty texts, null with a null.

    The longest common subsequence comes from bit-parallel rows: one big-integer step for each sign of ``b``.
    """
    if a is None or b is None:
        return None
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    return F.udf(in_del_ratio, "double", useArrow=True)(a, b)


def match_score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """weighted sum of part scores."""
    return sum((c * weights[n] for n, c in parts.items()), F.lit(0.0))


def step_score(x: Column) -> Column:
    """F8: points by absolute difference; missing 50."""
    a = F.abs(x)
    return F.when(a.isNull(), 50).when(a <= 2, 100).when(a <= 5, 90).when(a <= 10, 75).when(a <= 20, 50).when(a <= 40, 25).otherwise(0).cast("double")


def match_status(score: Column, has_text: Column, least: float = 80.0) -> Column:
    return F.when(score.isNull(), "not_found").when(~has_text, "no_lyrics").when(score >= least, "matched").otherwise("review")


def estimate_key(df: DataFrame, id_: str, chroma: str) -> DataFrame:
    """(id, key, mode, confidence): the best Pearson correlation with the 24 rotated profiles; null for a flat vector."""
    rows = []
    for mode, profile in (("major", MAJOR), ("minor", MINOR)):
        for tonic in range(12):
            turned = [profile[(i - tonic) % 12] for i in range(12)]
            mean = sum(turned) / 12
            size = sum((x - mean) ** 2 for x in turned) ** 0.5
            rows.append((tonic, mode, [(x - mean) / size for x in turned]))
    best = None
    mean = F.aggregate(chroma, F.lit(0.0), lambda a, x: a + x) / 12
    d = df.withColumn("_m", mean).withColumn("_c", F.transform(chroma, lambda x: x - F.col("_m")))
    d = d.withColumn("_s", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x)))
    for i, (tonic, mode, p) in enumerate(rows):
        r = sum((F.col("_c")[k] * p[k] for k in range(12)), F.lit(0.0)) / F.when(F.col("_s") > 0, F.col("_s"))
        one = F.struct(r.alias("r"), F.lit(-i).alias("i"), F.lit(PITCHES[tonic]).alias("key"), F.lit(mode).alias("mode"))
        best = [one] if best is None else [*best, one]
    return d.withColumn("_b", F.array_max(F.array(*best))).select(id_, F.when(F.col("_b.r").isNotNull(), F.col("_b.key")).alias("key"), F.when(F.col("_b.r").isNotNull(), F.col("_b.mode")).alias("mode"), F.round("_b.r", 4).alias("confidence"))
