import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.operators import communities as C, contracts as D, graph as G, paths as P, tables as O, vectors as V


def test_contracts(spark):
    a = spark.createDataFrame([(1, 0.5), (1, 2.0), (2, float("nan"))], "k int, x double")
    with pytest.raises(D.ContractError):
        D.require_columns(a, ["k", "gone"])
    assert D.select_present(a, ["x", "gone", "k", "x"]).columns == ["x", "k"]
    with pytest.raises(D.ContractError):
        D.checked_left_join(a, a, ["k"])
    assert D.checked_left_join(a, a.dropDuplicates(["k"]).select("k", F.lit(1).alias("y")), ["k"]).count() == 3
    assert {r.column: r.violations for r in D.out_of_bounds(a, {"x": (0, 1)}).collect()} == {"x": 1}
    assert D.usable_features(a, ["x", "k", "gone"], 2) == ["x", "k"]
    with pytest.raises(D.ContractError):
        D.no_leakage(["a", "label"], ["label"])
    with pytest.raises(D.ContractError):
        D.enforce(spark.createDataFrame([("c", "failed")], "check string, status string"))
    with pytest.raises(D.ContractError):
        D.expect_count(a, 4, "rows")


def test_coverage_class(spark):
    d = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    got = [r[0] for r in d.select(D.coverage_class(F.col("a"), F.col("b"), ("lyrics", "audio"))).collect()]
    assert got == ["lyrics_and_audio", "lyrics_only", "audio_only", "metadata_only"]


def test_percent_rank_of_ties(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 5.0), (5, None)], "id int, x double")
    assert {r.id: r.p for r in O.avg_pct_rank(d, "x", "p").collect()} == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0, 5: None}


def test_zscores(spark):
    z = O.zscores(spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "x double, c double"), ["x", "c"]).orderBy("x").collect()
    assert [round(r.x, 6) for r in z] == [-1.224745, 0, 1.224745] and [r.c for r in z] == [0, 0, 0]


def test_dedup_and_min_max(spark):
    d = spark.createDataFrame([("k", 1, "v1"), ("k", 2, "v2")], "k string, seq int, v string")
    assert O.first_by(d, ["k"], F.col("seq")).first().v == "v1" and O.first_by(d, ["k"], F.desc("seq")).first().v == "v2"
    assert [r.m for r in O.min_max(d.withColumn("c", F.lit(3.0)), "c", "m").collect()] == [0.5, 0.5]


def test_resolve_column():
    have = ["album", "Release Year", "score_x", "lyrics_nrc_anger_ratio"]
    assert O.resolve_column(have, ["year", "album"]) == "album"
    assert O.resolve_column(have, ["release_year"]) == "Release Year"
    assert O.resolve_column(have, ["score"]) == "score_x"
    assert O.resolve_column(have, ["anger ratio"]) == "lyrics_nrc_anger_ratio"
    assert O.resolve_column(have, ["none"]) is None


def test_append_features(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, n string"), spark.createDataFrame([(1, "y", 5), (1, "z", 6)], "id int, n string, f int")
    assert O.append_features(a, b, [["key"], ["id"]]).collect() == [(1, "x", 5)]
    assert O.append_features(a, b, [["key"]]).columns == ["id", "n"]


def test_hybrid(spark):
    d = spark.createDataFrame([(0.8, 0.5, None), (None, None, None)], "a double, b double, c double")
    s, n = V.hybrid({"a": 0.45, "b": 0.30, "c": 0.25})
    got = d.select(F.round(s, 6), n).collect()
    assert got == [(0.68, 2), (None, 0)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(2, 12), st.integers(0, 1000))
def test_cosine_is_symmetric_and_complete(spark, n, seed):
    rng = np.random.default_rng(seed)
    d = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(n)], "id long, v array<double>")
    rows = {(r.source, r.target): r.similarity for r in V.cosine_above(d, "id", "v", -1.0).collect()}
    assert len(rows) == n * (n - 1) and all(rows[a, b] == rows[b, a] and -1 <= rows[a, b] <= 1 for a, b in rows)


def _square(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7), (3, 4, 0.4)], "a long, b long, weight double").withColumn("distance", F.round(1 - F.col("weight"), 6))
    return nodes, e


def test_graph_basics(spark):
    nodes, e = _square(spark)
    tree = sorted((r.a, r.b) for r in G.spanning_forest(nodes, e).collect())
    assert tree == [(1, 2), (2, 3), (3, 4)]
    assert {r.id: r.component for r in G.components(nodes, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert {r.id: r.core for r in G.core_numbers(nodes, e).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 0}
    rank = {r.id: r["rank"] for r in G.pagerank(nodes, e, 30).collect()}
    assert math.isclose(sum(rank.values()), 1.0, abs_tol=1e-9) and rank[3] > rank[4] > rank[5]
    path = {r.id: r for r in P.shortest_paths(nodes, e).collect()}
    assert math.isclose(path[3].betweenness, 2 / 12 * 2 / 2 + 1 / 12 * 0, abs_tol=0.2) and path[5].closeness == 0
    c = {r.id: r.clustering for r in G.clustering(nodes, e).collect()}
    want = (0.9 * 0.8 * 0.7) ** (1 / 3) / 0.9
    assert math.isclose(c[1], want, abs_tol=1e-9) and math.isclose(c[3], want / 3, abs_tol=1e-9) and c[4] == 0
    two = C.louvain(nodes, e)
    q = G.modularity(e, two).first()[0]
    assert q >= G.modularity(e, nodes.select("id", F.lit(1).alias("community"))).first()[0]
    x = {r.id: r.x for r in G.eigenvector(nodes, e, 200, 1e-12).collect()}
    a = np.zeros((5, 5))
    for r in e.collect():
        a[r.a - 1, r.b - 1] = a[r.b - 1, r.a - 1] = r.weight
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert np.allclose([x[i] for i in range(1, 6)], v, atol=1e-3)


def test_edge_rule(spark):
    pairs = spark.createDataFrame([(1, 2, 0.2), (2, 1, 0.2), (2, 3, 0.9), (3, 2, 0.9), (2, 4, 0.8), (4, 2, 0.8)], "source long, target long, similarity double")
    rows = {(r.a, r.b): r for r in G.edges_from_pairs(pairs, 2, 0.32).collect()}
    assert rows[1, 2].by_top_k and not rows[1, 2].mutual_top_k and not rows[1, 2].by_threshold


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    scores, load, shares = V.pca(d, "id", ["a", "b", "c", "d"], 2)
    z = (x - x.mean(0)) / x.std(0)
    value, vector = np.linalg.eigh(z.T @ z / len(z))
    assert np.allclose(shares, value[::-1][:2] / value.sum())
    got = np.array([[r.pc1, r.pc2] for r in scores.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(z @ vector[:, ::-1][:, :2]), atol=1e-8)
    assert V.components_for([0.5, 0.45, 0.05]) == 2


def test_bootstrap_draws_the_references_resamples(spark, sf):
    from tessera.plans import analytics

    rows = lambda *n: {r["feature"]: r["low"] for r in analytics.bootstrap_ci(spark, sf, *n).collect()}
    got, want = rows(), rows(2000)
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], rel=1e-9) for f in want)


def test_pairs_block_to_block(spark, monkeypatch):
    """Several blocks give what one block gives, and what numpy gives."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(57, 6))
    d = spark.createDataFrame([(int(i), [float(c) for c in v], None if i % 9 == 0 else [float(c) for c in v[:3]], int(i % 4)) for i, v in enumerate(x)] + [(None, [1.0] * 6, None, 1), (99, None, None, 1)], "id long, v array<double>, w array<double>, g int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for block in (2000, 10):
        monkeypatch.setattr(V, "BLOCK", block)
        top = {(r.source, r["rank"]): r.target for r in V.cosine_top_k(d, "id", "v", 3, None, "g").collect()}
        for i in range(57):
            best = sorted((j for j in range(57) if j % 4 != i % 4), key=lambda j: (-s[i, j], j))[:3]
            assert [top[i, k] for k in (1, 2, 3)] == best
        grid = {(r.source, r.target): (r.v, r.w) for r in V.cosine_grid(d.where("id < 57"), "id", ["v", "w"]).collect()}
        assert len(grid) == 57 * 56 and all(np.isclose(a, s[i, j], atol=2e-6) and (b is None) == (i % 9 == 0 or j % 9 == 0) for (i, j), (a, b) in grid.items())
        near = {(r.source, r.target) for r in V.cosine_neighbours(d, "id", "v", 2, 0.6).collect()}
        for i in range(57):
            order = sorted((j for j in range(57) if j != i and s[i, j] > 0), key=lambda j: (-s[i, j], j))
            assert {(i, j) for j in range(57) if j != i and s[i, j] >= 0.6} | {(i, j) for j in order[:2]} <= near


@pytest.mark.parametrize("largest", [1, 20])
def test_blocks_grow_and_meet_once(spark, monkeypatch, largest):
    """However many the rows, there are few blocks until these are of the largest size; each pair of blocks meets in both orders."""
    for name, value in (("BLOCK", 1), ("LARGEST", largest), ("BLOCKS", 4)):
        monkeypatch.setattr(V, name, value)
    d = spark.range(60).selectExpr("id", "0L as apart", "array(double(id), 1.0) as v")

    def each(row, m, n):
        assert len(row["ids_a"]) == 8 * len(m[0]) and len(row["ids_b"]) == 8 * len(n[0])
        yield [np.frombuffer(row["ids_a"], np.int64)[:1], np.frombuffer(row["ids_b"], np.int64)[:1]]

    met = [tuple(r) for r in V._meet(d, ["v"], each, []).collect()]
    blocks = len({a for a, _ in met})
    assert len(met) == len(set(met)) == blocks**2 and (2 <= blocks <= 4 if largest == 20 else blocks > 30)


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    """No block is shuffled to its meetings, and a block's k nearest are merged from meeting to meeting of a task."""
    for name, value in (("BLOCK", 10), ("PART", 1 << 40)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(100)], "id long, v array<double>")
    met = V._near(d, "id", "v", 3, None, None, None)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and met.count() == 100 * 3


@pytest.mark.parametrize("block", [2000, 10])
def test_what_is_taken_from_the_grid_without_writing_it(spark, monkeypatch, block):
    """Counts, totals and best partners from the meetings of blocks are those of the whole table of pairs."""
    from tessera.operators.contracts import pair_table, pair_totals
    from tessera.operators.recommend import model_summary, recommend, summary_of_totals

    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, size=(12, 4)).astype(float)  # copies and equal scores
    rows = [(i % 55, [float(c) for c in x[i % 12]], None if i % 9 == 0 else [float(c) for c in x[i % 5, :2]], None if i % 11 == 0 else i % 3) for i in range(60)]
    d = spark.createDataFrame([*rows, (None, [1.0] * 4, None, 1), (99, None, None, 1)], "id long, v array<double>, w array<double>, g int")
    grid = V.cosine_grid(d, "id", ["v", "w"])
    assert pair_totals(V.grid_counts(d, "id"), d, "id").collect() == pair_table(grid, d, "id").collect()
    assert summary_of_totals(V.grid_totals(d, "id", ["v", "w"]), ["v", "w"], d, "id").collect() == model_summary(grid, ["v", "w"], d, "id").collect()
    once = d.where("id is null or id > 4")  # each id once
    weights = {"v": 0.45, "w": 0.3}
    score = F.round(V.hybrid(weights)[0], 9)
    want, got = (sorted(recommend(p.withColumn("h", score), "h", 2, None, once, "id", same="g", least=0.1).collect()) for p in (V.cosine_grid(once, "id", ["v", "w"]), V.grid_best(once, "id", weights, 2, 0.1, "g")))
    assert want == got and len(want) > 50


def test_pair_table_checks(spark):
    from tessera.operators import contracts as D

    e = spark.range(3).toDF("id")
    whole = [(a, b) for a in range(3) for b in range(3) if a != b]
    check = lambda rows: tuple(D.pair_table(spark.createDataFrame(rows, "source long, target long"), e, "id").first())
    assert check(whole) == (0, 0, 0) and check(whole[1:]) == (1, 0, 0) and check([*whole, (1, 1), whole[0]]) == (2, 1, 1)


def test_recommender_options_and_command_line(spark, tmp_path):
    from tessera.operators import recommend as R

    entities = spark.createDataFrame([(1, "One", "a"), (2, "Two", "a"), (3, "Three", "b"), (4, " two ", "b"), (5, "Five", None)], "id long, name string, era string")
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.8), (1, 5, 0.7), (3, 1, 0.2), (5, 1, None)], "source long, target long, hybrid double")
    got = lambda **o: [(r.source, r.target, r["rank"]) for r in R.recommend(pairs, "hybrid", attributes=entities, **o).orderBy("source", "rank").collect()]
    assert got(sources=[1]) == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 4)] and got(top_n=1) == [(1, 2, 1), (3, 1, 1)]
    assert got(apart="era", least=0.5) == [(1, 3, 1), (1, 4, 2)] and got(same="era") == [(1, 2, 1)]
    assert R.find_one(entities, "id", "name", " one") == 1
    with pytest.raises(R.NotFound):
        R.find_one(entities, "id", "name", "nobody")
    with pytest.raises(R.Ambiguous):
        R.find_one(entities, "id", "name", "two")
    for bad in ({"sources": [5]}, {"top_n": 0}):
        with pytest.raises(R.ContractError):
            got(**bad)
    entities.write.parquet(f"file://{tmp_path}/e")
    pairs.write.parquet(f"file://{tmp_path}/p")
    base = ["--entities", f"file://{tmp_path}/e", "--pairs", f"file://{tmp_path}/p"]
    assert [r.target_name for r in R.main([*base, "--name", "one", "--apart", "era", "--top-n", "1"], spark).collect()] == ["Three"]
    R.main([*base, "--all", "--save", f"file://{tmp_path}/out"], spark)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5
    assert R.main([*base, "--list"], spark).count() == 5
    with pytest.raises(SystemExit):
        R.main(base, spark)


def test_kmeans_finds_the_groups(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 25)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (20, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 4, 4))])
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    out, k = V.kmeans_select(d, "id", ["a", "b", "c"], 5, 4)
    by = {r.id: r.cluster for r in out.collect()}
    assert k == 3 and all(len({by[i] for i in range(g * 20, g * 20 + 20)}) == 1 for g in range(3)) and len(set(by.values())) == 3
    z = (x - x.mean(0)) / x.std(0)
    dist = np.linalg.norm(z[:, None] - z[None], axis=2)
    label = np.arange(60) // 20 % 2  # an arbitrary clustering in two
    s = []
    for i in range(60):
        a = dist[i, label == label[i]].sum() / ((label == label[i]).sum() - 1)
        o = dist[i, label != label[i]].mean()
        s.append((o - a) / max(a, o))
    named = spark.createDataFrame([(i, [float(v) for v in z[i]], int(label[i])) for i in range(60)], "id long, v array<double>, c2 long")
    assert np.isclose(V._silhouettes(named, [2])[2], np.mean(s), atol=1e-9)
    assert V.kmeans_select(d.limit(2), "id", ["a"], 5, 2)[1] == 1


def test_drift_matrix_has_every_feature_and_transition(spark, sf):
    from tessera.plans import analytics

    years = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("year(o_orderdate) y").distinct().count()
    got = analytics.drift_matrix(spark, sf).select("feature", "to_year").distinct().count()
    assert got == len(analytics.YF) * (years - 1)


@pytest.mark.parametrize("repeated", [False, True])
def test_edges_are_complete_where_blocks_meet(spark, monkeypatch, repeated):
    """The same edges as from all pairs grouped, with ties, large ids and vectors that are null, zero or not numbers; the
    pairs over the threshold pass no shuffle and no window."""
    monkeypatch.setattr(V, "BLOCK", 20)
    rng = np.random.default_rng(5)
    rows = [((1 << 60) - 7 * i if i % 2 else -i, rng.integers(-2, 3, 6).astype(float).tolist(), 0) for i in range(90)]
    rows += [(1000, None, 0), (1001, [0.0] * 6, 0), (1002, [float("nan")] * 6, 0), (None, [1.0] * 6, 0)] + rows[:3] * repeated
    d = spark.createDataFrame(rows, "id long, v array<double>, label int")
    found = V.cosine_graph(d, "id", "v", 3, 0.6)
    want = G.edges_from_pairs(V.cosine_neighbours(d, "id", "v", 3, 0.6), 3, 0.6)
    names = ["a", "b", "weight", "by_threshold", "by_top_k", "mutual_top_k", "distance"]
    got = sorted(map(tuple, found.select(names).collect()))
    assert got == sorted(map(tuple, want.select(names).collect())) and len(got) > 100
    assert ("Window" in found._jdf.queryExecution().executedPlan().toString()) == repeated
