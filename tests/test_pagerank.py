"""PageRank over packed edges: equal to the plain rounds, and no edge passes a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G


def plain(ids, edges, rounds):
    n, got = len(ids), {}
    out = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            out.setdefault(x, []).append((y, w))
    rank = {i: 1 / n for i in ids}
    for _ in range(rounds):
        loose, got = sum(rank[i] for i in ids if i not in out), {}
        for x in set(ids) & set(out):
            total = sum(w for _, w in out[x])
            for y, w in out[x]:
                got[y] = got.get(y, 0) + rank[x] * ids.count(x) * w / total
        rank = {i: 0.15 / n + 0.85 * (got.get(i, 0) + loose / n) for i in ids}
    return rank


@pytest.mark.parametrize("ids", [list(range(40)), [-(1 << 62), 7, (1 << 53) + 1, 7, *range(100, 130)], [None, *range(30)]])
def test_equal_to_the_plain_rounds(spark, monkeypatch, ids):
    monkeypatch.setattr(G, "PACKED", 17)
    monkeypatch.setattr(G, "SLICE", 8)
    r = random.Random(3)
    linked = sorted({i for i in ids if i is not None})[:-4]
    edges = list({(a, b): (a, b, w) for a, b, w in ((*sorted(r.sample(linked, 2)), r.choice([0.333333, 0.5, 0.1234567891])) for _ in range(150))}.values())
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    found = G.pagerank(nodes, spark.createDataFrame(edges, "a long, b long, weight double").repartition(3), 4).collect()
    want = plain(ids, edges, 4)
    assert sorted(map(str, (x.id for x in found))) == sorted(map(str, ids))
    assert all(abs(x["rank"] - want[x.id]) < 1e-12 for x in found)


def test_small_and_odd_graphs(spark):
    nodes, none = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([], "a long, b long, weight double")
    assert {(x.id, round(x["rank"], 9)) for x in G.pagerank(nodes, none).collect()} == {(1, 0.5), (2, 0.5)}
    assert G.pagerank(nodes.where("id > 5"), none).count() == 0
    texts = spark.createDataFrame([("x",), ("y",)], "id string")
    assert {(x.id, round(x["rank"], 9)) for x in G.pagerank(texts, spark.createDataFrame([("x", "y", 1.0)], "a string, b string, weight double")).collect()} == {("x", 0.5), ("y", 0.5)}


def test_larger_graphs_go_by_tables(spark, monkeypatch):
    nodes, edges = spark.range(9), spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25), (3, 4, 1.0)], "a long, b long, weight double")
    one = {x.id: x["rank"] for x in G.pagerank(nodes, edges, 5).collect()}
    monkeypatch.setattr(G, "NODES", 4)
    two = {x.id: x["rank"] for x in G.pagerank(nodes, edges, 5).collect()}
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-12 for i in one)


def test_edges_are_read_once_and_written_packed(spark, monkeypatch):
    """Tables of edges in both directions, joined each round, took the disk."""
    written, real, read = [], G.materialize, spark.sparkContext.accumulator(0)

    def noted(df, label, **options):
        out = real(df, label, **options)
        written.append((label, out.count()))
        return out

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(G, "materialize", noted)
    edges = spark.range(5000).select((F.col("id") % 70).alias("a"), (F.col("id") % 70 + 1 + F.col("id") % 13).alias("b"), F.lit(0.5).alias("weight"))
    G.pagerank(spark.range(90), edges.mapInArrow(counted, edges.schema), 4)
    assert read.value == 5000 and max(n for _, n in written) < 100
