"""UMAP by tables.

Graph: each row's nearest others come from blocks that meet block to block; the distance to the nearest apart one is
taken off, and a scale is found by bisection so that the weights exp(-(d - nearest) / scale) sum to log2 of their number,
in one expression. A pair's weight is the fuzzy union of its two directions, u + v - uv.

Layout, a table of positions a round. An edge takes part in the share of rounds that its weight has of the largest, as
evenly as rounds allow. A row moves along the mean pull of its edges of the round and away from NEGATIVES rows drawn by
digest, which are found by row number. So a round costs two joins with the edges and one of NEGATIVES places a row,
linear in rows; nothing passes the driver or one task, and the same table gives the same layout.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.embedding import BISECTIONS, centred, nearest, prepared
from tessera.operators.graph import both_ways
from tessera.operators.tables import global_rank
from tessera.storage import contained, materialize

#: Rows that push a row in a round; the most that one pull or push counts along an axis; the longest step of a round:
#: all rows move at once, so that longer ones would overshoot.
NEGATIVES, CLIP, STEP = 5, 4.0, 0.5
#: The spread of the first principal axis at the start.
WIDTH = 5.0


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """(a, b, w), both directions with the same weight, from (source, target, d2)."""
    rows = near.groupBy("source").agg(F.collect_list(F.struct("target", F.sqrt("d2").alias("d"))).alias("near"))  # the neighbours asked for
    apart = F.filter(F.transform("near", lambda e: e["d"]), lambda d: d > 0)
    rows = rows.withColumn("least", F.coalesce(F.array_min(apart), F.lit(0.0)))
    rows = rows.withColumn("x", F.transform("near", lambda e: F.greatest(F.lit(0.0), e["d"] - F.col("least")))).withColumn("wanted", F.log2(F.size("near").cast("double")))

    def step(s: Column, _: Column) -> Column:
        much = F.aggregate("x", F.lit(0.0), lambda q, x: q + F.exp(-x / s["scale"])) > F.col("wanted")
        more = F.when(s["high"] == float("inf"), s["scale"] * 2).otherwise((s["scale"] + s["high"]) / 2)
        return F.struct(F.when(much, s["low"]).otherwise(s["scale"]).alias("low"), F.when(much, s["scale"]).otherwise(s["high"]).alias("high"), F.when(much, (s["low"] + s["scale"]) / 2).otherwise(more).alias("scale"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(1.0).alias("scale"))
    found = rows.withColumn("scale", F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, step)["scale"])
    # Many rows at the nearest distance give more than is wanted at any scale: it stays above a share of the mean distance.
    mean = F.aggregate("near", F.lit(0.0), lambda q, e: q + e["d"]) / F.size("near")
    found = materialize(found.withColumn("scale", F.greatest("scale", 1e-3 * mean, F.lit(1e-12))), "scales")
    one = found.select(F.col("source").alias("a"), "x", "near", "scale", F.posexplode("near").alias("i", "e")).select("a", F.col("e")["target"].alias("b"), F.exp(-F.get("x", F.col("i")) / F.col("scale")).alias("w"))
    # Both directions of a pair, if both stand: u + v - uv = 1 - (1 - u)(1 - v).
    return materialize(both_ways(one, "w").groupBy("a", "b").agg((F.sum("w") - F.when(F.count("*") > 1, F.product("w")).otherwise(0.0)).alias("w")), "fuzzy")


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1 / (1 + a x^2b) nearest, by least squares, to 1 up to ``min_dist`` and exp(-(x - min_dist) / spread) beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([1.0, 1.0]), 1e-2
    value = lambda p: 1 / (1 + p[0] * x ** (2 * p[1]))
    for _ in range(200):
        f = value(p)
        slope = np.stack([-f * f * x ** (2 * p[1]), -f * f * p[0] * x ** (2 * p[1]) * 2 * np.log(x)], axis=1)
        square = slope.T @ slope
        move = np.linalg.solve(square + damp * np.diag(np.diag(square)), slope.T @ (y - f))
        better = ((y - value(p + move)) ** 2).sum() < ((y - f) ** 2).sum()
        p, damp = (p + move, damp / 3) if better else (p, damp * 3)
    return float(p[0]), float(p[1])


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), c))


def layout(start: DataFrame, edges: DataFrame, n: int, rounds: int, min_dist: float) -> DataFrame:
    """(id, row, y0, y1) after ``rounds`` rounds from ``start`` (id, row from 1, y0, y1)."""
    a, b = curve(min_dist)
    most = edges.agg(F.max("w")).first()[0]
    state = materialize(start.select("id", "row", "y0", "y1"), "layout")
    place = lambda s, c: s.select(F.col("id").alias(c), F.col("y0").alias(f"{c}0"), F.col("y1").alias(f"{c}1"))
    for t in range(rounds):
        rate = 1.0 - t / rounds
        # An edge's turns are spread by its own phase, so that edges of one weight do not all wait for the same round.
        phase = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.lit(1 << 20)) / float(1 << 20)
        turn = lambda k: F.floor(phase + k * F.col("w") / most)  # noqa: B023, E731
        pairs = edges.where(turn(t + 1) > turn(t)).select("a", "b").join(place(state, "b"), "b").join(place(state, "a"), "a")
        d = [F.col(f"a{k}") - F.col(f"b{k}") for k in (0, 1)]
        d2 = d[0] * d[0] + d[1] * d[1]
        force = F.when(d2 > 0, -2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b)))).otherwise(0.0)
        pull = pairs.groupBy(F.col("a").alias("id")).agg(*(F.avg(_clip(force * d[k])).alias(f"g{k}") for k in (0, 1)))
        drawn = F.transform(F.sequence(F.lit(1), F.lit(NEGATIVES)), lambda j: F.pmod(F.xxhash64("id", F.lit(t), j), F.lit(n)) + 1)  # noqa: B023
        others = state.select(F.col("row").alias("drawn"), F.col("id").alias("other"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))
        met = state.select("id", F.col("y0").alias("a0"), F.col("y1").alias("a1"), F.explode(drawn).alias("drawn")).join(others, "drawn").where("id <> other")
        away = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, F.lit(b))))
        # Rows at one place part by their ids.
        side = [F.when(d2 > 0, _clip(away * d[k])).otherwise(CLIP * F.signum((F.col("id") - F.col("other")).cast("double"))) for k in (0, 1)]
        push = met.groupBy("id").agg(*(F.sum(side[k]).alias(f"h{k}") for k in (0, 1)))
        moved = state.join(pull, "id", "left").join(push, "id", "left")
        # A row without an edge in the round stays: pulls and pushes come together.
        move = [F.when(F.col("g0").isNotNull(), rate * (F.col(f"g{k}") + F.coalesce(f"h{k}", F.lit(0.0)))).otherwise(0.0) for k in (0, 1)]
        moved = moved.select("id", "row", "y0", "y1", move[0].alias("m0"), move[1].alias("m1"))
        short = F.least(F.lit(1.0), STEP / F.greatest(F.sqrt(F.col("m0") * F.col("m0") + F.col("m1") * F.col("m1")), F.lit(1e-12)))
        state = materialize(moved.select("id", "row", *((F.col(f"y{k}") + F.col(f"m{k}") * short).alias(f"y{k}") for k in (0, 1))), "layout")
    return state


@contained
def umap(df: DataFrame, id_: str, vector: str, neighbours: int = 12, min_dist: float = 0.15, rounds: int = 200) -> DataFrame:
    """(id, x, y) of every row, centred: UMAP from the two principal axes. The neighbours count the row itself and are at
    most all rows but one. Rows without a finite vector have null coordinates; with fewer than four finite rows all are
    0; ids are integers, and rows that repeat one count once, by the smaller vector; shorter vectors count as filled up
    with zeros; equal vectors are neighbours at distance 0."""
    rows, known, axes, n = prepared(df, id_, vector)
    if axes is None:
        return centred(rows, None)
    edges = fuzzy_graph(nearest(known, "id", "v", max(2, min(neighbours, n - 1) - 1)))
    start = global_rank(axes.select("id", *((F.col(c) * WIDTH).alias(c) for c in ("y0", "y1"))), F.col("id"), "row")
    return centred(rows, layout(start, edges, n, rounds, min_dist))
