"""Graph operators as tables against plain walks on the same graph."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import communities as C, graph as G, paths as P, vectors as V

EDGES = "a long, b long, weight double, distance double"


def frame(spark, n, edges):
    return spark.range(n).toDF("id"), spark.createDataFrame([(a, b, w, 1 - w) for a, b, w in edges], EDGES)


def random_graph(n, degree, seed, groups=1, inside=1.0):
    """Edges (a, b, weight), a < b; weights on a coarse grid, so that paths tie."""
    rng = random.Random(seed)
    found = {}
    while len(found) < n * degree // 2:
        a = rng.randrange(n)
        b = rng.randrange(n)
        if a != b and (a % groups == b % groups or rng.random() > inside):
            found[min(a, b), max(a, b)] = rng.choice([0.25, 0.5, 0.75, 0.875])
    return [(a, b, w) for (a, b), w in sorted(found.items())]


def neighbours(n, edges):
    near = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    return near


def walks(n, edges):
    """Dijkstra and Brandes from each node."""
    near, between, own = neighbours(n, edges), [0.0] * n, []
    for s in range(n):
        dist, count, before, order, heap, seen = {}, {s: 1}, {s: []}, [], [(0.0, s)], {s: 0.0}
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, w in near[v].items():
                new = d + 1 - w
                if u not in seen or new < seen[u] - 1e-12:
                    seen[u], count[u], before[u] = new, count[v], [v]
                    heapq.heappush(heap, (new, u))
                elif u not in dist and abs(new - seen[u]) <= 1e-12:
                    count[u] += count[v]
                    before[u].append(v)
        gain = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in before[u]:
                gain[v] += count[v] / count[u] * (1 + gain[u])
            if u != s:
                between[u] += gain[u]
        reach, total = len(dist) - 1, sum(dist.values())
        own.append((reach / total * reach / (n - 1) if total else 0.0, sum(1 / d for d in dist.values() if d), total, reach))
    return [(i, b / ((n - 1) * (n - 2)), *o) for i, (b, o) in enumerate(zip(between, own, strict=True))]


@pytest.mark.parametrize(("n", "degree", "seed", "sources"), [(40, 4, 1, 1024), (20, 2, 2, 12)], ids=["one batch", "batches and islands"])
def test_path_centralities_as_by_walks(spark, n, degree, seed, sources):
    edges = random_graph(n, degree, seed)
    got = sorted(map(tuple, P.shortest_paths(*frame(spark, n, edges), sources=sources).collect()))
    for mine, want in zip(got, walks(n, edges), strict=True):
        assert mine == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("held", [0, P.HELD], ids=["tables", "arrays"])
def test_paths_by_tables_and_by_arrays(spark, monkeypatch, held):
    """Few edges walk as arrays from all sources in one job, not as a table a round; both ways give the plain walks."""
    monkeypatch.setattr(P, "HELD", held)
    written = []
    monkeypatch.setattr(P, "materialize", lambda df, label, *a, m=P.materialize: (written.append(label), m(df, label, *a))[1])
    edges = random_graph(30, 4, 7)
    got = sorted(map(tuple, P.shortest_paths(*frame(spark, 30, edges)).collect()))
    for mine, want in zip(got, walks(30, edges), strict=True):
        assert mine == pytest.approx(want, abs=1e-9)
    assert ("front" in written) == (held == 0)
    n, most, mean = P.diameter(*frame(spark, 30, edges)).first()
    size = 1 + max(w[5] for w in walks(30, edges))
    assert (n, mean) == (size, pytest.approx(sum(w[4] for w in walks(30, edges) if w[5] == size - 1) / (size * (size - 1)))) and most >= 3


def test_paths_of_odd_graphs(spark):
    nodes, edges = frame(spark, 4, [(0, 1, 1.0), (1, 2, 0.5), (1, 1, 0.5), (2, 1, 0.25)])  # no length, a loop, a repeated edge
    edges = edges.unionByName(spark.createDataFrame([(None, 2, 0.5, 0.5), (0, 3, 0.5, None), (0, 3, 0.5, math.inf)], EDGES))
    got = {r.id: r for r in P.shortest_paths(nodes, edges.withColumn("s", F.lit(1))).collect()}
    assert got[1].betweenness == pytest.approx(2 / 6) and got[2].path_sum == pytest.approx(1.0) and got[0].reached == 2
    assert got[3][1:] == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert sorted(P.shortest_paths(*frame(spark, 3, [])).collect()) == [(i, *[0.0] * 5) for i in range(3)]
    assert P.shortest_paths(*frame(spark, 0, [])).collect() == []
    assert P.diameter(*frame(spark, 3, [])).first()["diameter"] is None


def test_a_path_longer_than_a_plan(spark):
    n = 12
    nodes, edges = frame(spark, n, [(i, i + 1, 0.5) for i in range(n - 1)])
    got = {r.id: r for r in P.shortest_paths(nodes, edges).collect()}
    assert got[0].path_sum == pytest.approx(0.5 * n * (n - 1) / 2) and got[5].betweenness == pytest.approx(2 * 5 * (n - 6) / ((n - 1) * (n - 2)))
    span = P.diameter(nodes, edges).first()
    assert tuple(span) == (n, n - 1, pytest.approx(0.5 * (n + 1) / 3))


def modularity(near, group):
    m2 = sum(sum(x.values()) for x in near)
    total, inner = {}, 0.0
    for v, x in enumerate(near):
        total[group[v]] = total.get(group[v], 0.0) + sum(x.values())
        inner += sum(w for u, w in x.items() if group[u] == group[v])
    return inner / m2 - sum((t / m2) ** 2 for t in total.values())


def plain_louvain(near):
    """One node after the other; the modularity that it reaches."""
    links, member, loops = [dict(x) for x in near], list(range(len(near))), [0.0] * len(near)
    while True:
        degree = [sum(x.values()) + loops[i] for i, x in enumerate(links)]
        m2, group, total, any_moved, moved = sum(degree), list(range(len(links))), degree[:], False, True
        while moved:
            moved = False
            for v, x in enumerate(links):
                by = {group[v]: 0.0}
                for u, w in x.items():
                    by[group[u]] = by.get(group[u], 0.0) + w
                total[group[v]] -= degree[v]
                best = max(sorted(by), key=lambda c: (round(by[c] - total[c] * degree[v] / m2, 12), c == group[v]))
                total[best] += degree[v]
                if best != group[v]:
                    group[v], moved, any_moved = best, True, True
        if not any_moved:
            return modularity(near, member)
        names = {c: i for i, c in enumerate(dict.fromkeys(group))}
        new, fresh = [{} for _ in names], [0.0] * len(names)
        for v, x in enumerate(links):
            c = names[group[v]]
            fresh[c] += loops[v]
            for u, w in x.items():
                e = names[group[u]]
                if e == c:
                    fresh[c] += w
                else:
                    new[c][e] = new[c].get(e, 0.0) + w
        member, links, loops = [names[group[x]] for x in member], new, fresh


@pytest.mark.parametrize(("n", "degree", "groups", "inside"), [(90, 10, 3, 0.97), (150, 4, 1, 1.0)], ids=["planted", "noise"])
def test_communities_are_as_good_as_one_by_one(spark, n, degree, groups, inside):
    edges = random_graph(n, degree, 3, groups, inside)
    nodes, table = frame(spark, n, edges)
    found = C.louvain(nodes, table)
    group = dict(map(tuple, found.collect()))
    near = neighbours(n, edges)
    q = modularity(near, group)
    assert q == pytest.approx(G.modularity(table, found).first()[0]) and q > plain_louvain(near) - 0.01
    sizes = [sum(c == k for c in group.values()) for k in range(1, max(group.values()) + 1)]
    assert sorted(group) == list(range(n)) and sizes == sorted(sizes, reverse=True) and min(sizes) > 0
    if groups > 1:
        assert sizes == [n // groups] * groups and all(group[i] == group[i % groups] for i in range(n))


@pytest.mark.parametrize("nodes", [4096, 40], ids=["one block", "blocks"])
def test_communities_move_in_blocks(spark, monkeypatch, nodes):
    """A level of a small graph is one step; of more blocks a few. By halves and single nodes it took dozens of tables."""
    monkeypatch.setattr(C, "NODES", nodes)
    written = []
    monkeypatch.setattr(C, "materialize", lambda df, label, *a, m=C.materialize: (written.append(label), m(df, label, *a))[1])
    edges = random_graph(150, 4, 3)
    group = dict(map(tuple, C.louvain(*frame(spark, 150, edges)).collect()))
    near = neighbours(150, edges)
    assert modularity(near, group) > plain_louvain(near) - (0.01 if nodes > 150 else 0.04)
    if nodes > 150:
        assert written.count("moves") + written.count("wishes") <= 8


def test_communities_of_odd_graphs(spark):
    nodes, edges = frame(spark, 6, [(0, 1, 0.5), (1, 2, 0.5), (0, 2, 0.5), (2, 2, 9.0), (3, 4, 0.5), (0, 1, 0.25)])
    edges = edges.unionByName(spark.createDataFrame([(None, 1, 1.0, 0.0), (4, 5, 0.0, 1.0), (4, 5, -1.0, 1.0), (4, 5, None, 1.0)], EDGES)).withColumn("c", F.lit(1)).withColumn("k", F.lit(1))
    assert dict(map(tuple, C.louvain(nodes, edges).collect())) == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    assert dict(map(tuple, C.louvain(*frame(spark, 2, [])).collect())) == {0: 1, 1: 2}
    assert C.louvain(*frame(spark, 0, [])).collect() == []


def test_no_graph_is_collected(spark, monkeypatch):
    """A sweep over a million edges is joins and grouped sums: planned, not gathered."""
    links = spark.range(1_000_000).select((F.col("id") % 200_000).alias("a"), (F.col("id") * 7 % 200_000).alias("b"), F.lit(1.0).alias("w"))
    labels = spark.range(200_000).select("id", F.lit(5.0).alias("k"), (F.col("id") % 900).alias("c"))
    moved = C.moved(labels, C.alone(links, C.wishes(links, labels, 1e6, 1.0, F.col("id") % 2 == 0), 1))
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop", "SinglePartition"))
    assert moved.where(F.col("c") != F.col("id") % 900).where("id % 2 = 1").count() == 0 and moved.count() == 200_000


def peeled(n, edges):
    near, core, k = neighbours(n, edges), {}, 0
    live = set(range(n))
    while live:
        v = min(live, key=lambda x: sum(u in live for u in near[x]))
        k = max(k, sum(u in live for u in near[v]))
        core[v] = k
        live.remove(v)
    return core


def test_core_numbers_as_by_peeling(spark):
    edges = random_graph(60, 6, 4)
    assert dict(map(tuple, G.core_numbers(*frame(spark, 61, edges)).collect())) == peeled(61, edges)
    assert sorted(G.core_numbers(*frame(spark, 2, [(0, 0, 1.0)])).collect()) == [(0, 0), (1, 0)]


@pytest.mark.parametrize("basis", [10, 24])
def test_eigenvector_as_by_numpy(spark, basis):
    edges = random_graph(50, 8, 5)
    x = dict(map(tuple, G.eigenvector(*frame(spark, 51, edges), basis=basis).collect()))
    m = np.zeros((51, 51))
    for a, b, w in edges:
        m[a, b] = m[b, a] = w
    want = np.abs(np.linalg.eigh(m)[1][:, -1])
    assert np.allclose([x[i] for i in range(51)], want, atol=1e-8)
    assert sorted(G.eigenvector(*frame(spark, 4, [])).collect()) == [(i, 0.5) for i in range(4)]
    assert G.eigenvector(*frame(spark, 0, [])).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 40], ids=["one block", "blocks"])
def test_triangles_where_blocks_of_edges_meet(spark, monkeypatch, block):
    """As by three loops; no pair of edges is a row: the plan joins no edges with edges."""
    monkeypatch.setattr(G, "EDGES", block)
    edges = random_graph(50, 14, 6)
    nodes, table = frame(spark, 52, edges)
    near, top, want = neighbours(50, edges), max(w for _, _, w in edges), [0.0] * 52
    for a in range(50):
        for b in near[a]:
            for c in near[a].keys() & near[b].keys():
                want[a] += (near[a][b] * near[b][c] * near[a][c]) ** (1 / 3) / top / (len(near[a]) * (len(near[a]) - 1))
    got = G.clustering(nodes, table)
    assert [r.clustering for r in got.orderBy("id").collect()] == pytest.approx(want, abs=1e-9) and sum(want) > 0
    assert G.triangles(table.withColumnRenamed("weight", "w"))._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    assert all(r.clustering == 0 for r in G.clustering(*frame(spark, 3, [])).collect()) and G.clustering(*frame(spark, 3, [])).count() == 3


@pytest.mark.parametrize("query", ["node_degree", "group_interactions", "modularity_by_label", "graph_gexf", "graph_export"])
def test_edges_that_are_read_once_are_not_written(spark, sf, monkeypatch, query):
    """No table of all edges lies on the disk, and none is shuffled to find its ends' labels."""
    from tessera.plans import analytics

    written, write = [], analytics.materialize
    monkeypatch.setattr(analytics, "materialize", lambda df, label, **more: written.append(label) or write(df, label, **more))
    assert getattr(analytics, query)(spark, sf).limit(1).count()
    assert "edges" not in written


def test_edges_bring_labels_along(spark, monkeypatch):
    """As joined, with labels that are null, and modularity from the sums between labels is that of the edges."""
    monkeypatch.setattr(V, "BLOCK", 20)
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(i, rng.integers(-2, 3, 6).astype(float).tolist(), None if i % 8 == 0 else i % 3 - 1) for i in range(70)], "id long, v array<double>, label int")
    got = V.cosine_graph(d, "id", "v", 3, 0.6, "label").cache()
    label = {r.id: r.label for r in d.collect()}
    rows = got.collect()
    assert len(rows) > 100 and {r.by_threshold for r in rows} == {True, False} and all((r.la, r.lb) == (label[r.a], label[r.b]) for r in rows)
    plain = V.cosine_graph(d, "id", "v", 3, 0.6)
    assert sorted(got.select(plain.columns).collect()) == sorted(plain.collect())
    want = G.modularity(plain, d.selectExpr("id", "label as community")).first()[0]
    assert abs(G.modularity_between(G.between_groups(got)).first()[0] - want) < 1e-12


def test_edges_are_thinned_out_where_they_are_read(spark, monkeypatch):
    """The forest and the components are those of all edges, but a task sends fewer edges than there are nodes."""
    monkeypatch.setattr(G, "HELD", 30)
    edges = random_graph(60, 12, 8) + [(70 + i, 71 + i, 0.5) for i in range(3)]
    nodes, table = frame(spark, 75, edges)
    kept = sorted((1 - w, a, b) for a, b, w in edges)
    group, want = list(range(75)), []
    for d, a, b in kept:
        if group[a] != group[b]:
            want.append((d, a, b))
            group = [group[a] if g == group[b] else g for g in group]
    assert G.thinned(table.coalesce(1)).count() == len(want) and G.thinned(table.limit(0)).count() == 0
    assert sorted(map(tuple, G.spanning_forest(nodes, table.repartition(3), whole=True).collect())) == want
    least = {g: min(i for i in range(75) if group[i] == g) for g in group}
    assert dict(map(tuple, G.components(nodes, table.repartition(3)).collect())) == {i: least[g] for i, g in enumerate(group)}
