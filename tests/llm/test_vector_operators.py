"""Codes, collision counting and hard negatives against brute force, and what odd inputs give."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import codes, collisions, negatives
from tessera.llm.vectors import integers, whole
from tessera.storage import scratch

SCHEMA = "vec_id long, embedding array<double>, label int, v string, id string, code string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale, width):
    return [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v] + [0] * (width - len(v))


def clusters(n, width, seed, groups=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    return [(i, (middles[i % groups] + rng.normal(size=width) * 0.2).tolist(), int(rng.integers(4))) for i in range(n)]


ODD = [
    (7, None, 1), (8, [], 1), (9, [1.0, None], 1), (10, [NAN, 1.0], 0), (11, [INF, 1.0], 0), (12, [0.25, 0.5, -0.75], None),
    (13, [0.0, 0.0], 2), (100, [0.25, 0.5, -0.75], 2), (0, [1.0, -1.0, 0.5, 0.25], 1), (3, [1.0, -1.0, 0.5, 0.25], 1), (4, [1.0, -1.0, 0.5, 0.25], 1),
    (200, [0.9, -1.0, 0.5, 0.25], 1), (200, [0.9, -1.0, 0.5, 0.25], 1), (201, [-0.5, 0.3, 0.1, 0.2], 3), (202, [0.3, -0.4, 0.1, 0.2], 3), (203, [0.3, -0.4, 0.1, 0.2], None),
]
#: Beyond what 38 digits or doubles hold.
HUGE = [(300, [1e306, 1.0, -1e300, 0.0], 1), (400, [1e200, 0.5, 2.0, 0.0], 3), (401, [-1e306, 1.0, 1.0, 0.0], 1), (402, [1e130, 1e20, 1e17, 0.0], 2)]


# Codes


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, v, l) for i, v, l in rows if usable(v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    w = max(1, -(-longest // parts))
    x = [floors(v, scale, w * parts) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [*kept[k][1]]))[:entries]
    cut = lambda r, p: r[p * w : (p + 1) * w]
    books = [[cut(x[k], p) for k in first] for p in range(parts)]
    far = lambda a, b: sum((m - n) ** 2 for m, n in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(b)), key=lambda e: (far(cut(r, p), b[e]), e)) for p, b in enumerate(books)] for r in x]
    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(r, p) for r, o in zip(x, own, strict=True) if o[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = assign()
    error = [min(2**63 - 1, sum(far(cut(r, p), books[p][o[p]]) for p in range(parts))) for r, o in zip(x, own, strict=True)]
    total = {}
    for (_, _, l), e in zip(kept, error, strict=True):
        total[l] = min(2**63 - 1, total.get(l, 0) + e)
    digest = hashlib.sha256(",".join(str(n) for b in books for e in b for n in e).encode()).hexdigest()
    return sorted(((i, bytes(o).hex(), e, total[l], digest) for (i, _, l), o, e in zip(kept, own, error, strict=True)), key=repr)


@pytest.mark.parametrize("rows", [clusters(400, 16, 1), clusters(90, 13, 2), ODD, ODD + HUGE, clusters(5, 8, 3), [(i, [1.0, 2.0], 0) for i in range(40)] + [(99, [3.0, -2.0], 1)]], ids=["clusters", "odd width", "odd", "huge", "few", "copies"])
def test_codes_are_lloyds(spark, rows):
    found = codes.report(frame(spark, rows).repartition(3))
    assert sorted(map(tuple, found.collect()), key=repr) == lloyd(rows)


def test_codes_of_an_empty_table(spark):
    assert codes.report(frame(spark, [])).collect() == []
    assert codes.report(frame(spark, [(1, None, 0)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_a_null_key_is_coded_and_comes_last(spark):
    rows = [(None, [float(i), 1.0], 0) for i in range(3)] + [(i, [i * 0.5, -1.0], 0) for i in range(15)]
    assert sorted(map(tuple, codes.report(frame(spark, rows)).collect()), key=repr) == lloyd(rows)


def test_later_rounds_measure_few_parts(spark):
    measured = []
    codes.compress(frame(spark, clusters(2000, 16, 4)), measured=measured)
    assert len(measured) == 7 and measured[0] == 2000 * 8
    assert measured[-1] < measured[0] / 4, measured  # most parts keep their entry by their bound alone


def test_decoded_vectors_lie_as_far_as_the_error_says(spark):
    got, centres = codes.compress(frame(spark, clusters(300, 16, 5)))
    table = codes.decode(got, centres).join(frame(spark, clusters(300, 16, 5)).select(F.col("vec_id").alias("id"), "embedding"), "id")
    for r in table.collect():
        exact = sum((math.floor(a * 4096) - (b * 4096 - 0.5)) ** 2 for a, b in zip(r.embedding, r.approximate, strict=True))
        assert round(exact) == r.error


def test_a_heap_gives_up_what_the_sum_has_reached():
    h = codes.Heaps(2)
    h.push(0, [(3.0, 1), (1.0, 2), (2.0, 3)])
    again = codes.Heaps(2, *h.arrays())
    assert again.pop(0, 0.5) == [] and not again.lists  # not even opened
    assert again.pop(0, 2.0) == [2, 3] and again.pop(1, 9.0) == []
    assert again.arrays()[0].tolist() == [3.0]


@pytest.mark.parametrize("n", [0, 1, -1, 2**40, -(2**40), 3**90, -(7**400)])
def test_limbs_add_up(n):
    assert sum(s << codes.LIMB * i for i, s in enumerate(codes.limbs(n))) == n
    assert all(abs(s) < 2**41 for s in codes.limbs(n))


def test_whole_numbers_are_floors():
    x = np.array([[0.1, -0.1, 1e306, -3.5, 5e-324, -5e-324]])
    assert integers(whole(x, 1024))[0].tolist() == [102, -103, int(1e306) * 1024, -3584, 0, -1]


# Collision counting


def nearest(rows, k=10, every=100):
    kept = [(i, v) for i, v, _ in rows if i is not None and usable(v) and any(v)]
    width = max((len(v) for _, v in kept), default=0)
    full = [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v in kept]
    out = {}
    for i, v in full:
        if i % every == 0:
            out[i] = sorted((math.dist(v, u) if np.abs(v - u).max() < 1e300 else INF, j) for j, u in full if j != i)[:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r[0], []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r[0]])
    return out


@pytest.mark.parametrize(("rows", "least"), [(clusters(3000, 24, 6), 0.95), ([(i, np.random.default_rng(i).normal(size=64).tolist(), 0) for i in range(2000)], 0.9)], ids=["clusters", "noise"])
def test_collision_counting_finds_the_neighbours(spark, rows, least):
    true, got = nearest(rows), answers(collisions.neighbours(frame(spark, rows).repartition(5)))
    assert got.keys() == true.keys()
    hits = sum(len({j for _, j in got[q]} & {j for _, j in true[q]}) for q in true)
    assert hits >= least * sum(map(len, true.values()))
    exact = {(q, j): d for q, best in true.items() for d, j in best}
    assert all(math.isclose(d, exact[q, j], rel_tol=1e-12) for q, best in got.items() for d, j in best if (q, j) in exact)


def test_windows_spare_most_of_a_clustered_table(spark):
    rows = clusters(4000, 24, 7, groups=40)
    vectors = collisions.usable(frame(spark, rows).coalesce(1), "vec_id", "embedding")
    asked = [(i, v) for i, v, _ in rows if i % 100 == 0]
    verified = collisions.search(collisions.build(vectors, 24), asked, 24, 10).agg(F.sum("verified")).first()[0]
    assert verified < 0.2 * len(asked) * len(rows)


def test_copies_tie_by_the_smaller_key(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(400)] + clusters(50, 3, 8)[:0]
    got = answers(collisions.neighbours(frame(spark, rows).repartition(4)))
    assert got[100] == [(0.0, i) for i in range(10)] and got[0] == [(0.0, i) for i in range(1, 11)]


def test_collision_counting_of_odd_rows(spark):
    rows = ODD + HUGE + [(None, [1.0, 2.0], 1)]
    true, got = nearest([r for r in rows if r[0] is not None]), answers(collisions.neighbours(frame(spark, rows)))
    assert got.keys() == true.keys() == {0, 100, 200, 300, 400}
    assert [j for _, j in got[0]][:3] == [3, 4, 200] and not {7, 8, 9, 10, 11, 13} & {j for best in got.values() for _, j in best}
    assert math.isclose(got[400][0][0], 1e200) and [j for _, j in got[300]] == sorted(j for _, j in got[300])  # all as far, in doubles
    assert collisions.neighbours(frame(spark, [])).collect() == [] and collisions.neighbours(frame(spark, [(1, [1.0], 0)])).collect() == []
    assert answers(collisions.neighbours(frame(spark, [(100, [1.0], 0), (2, [2.0], 0)]))) == {100: [(1.0, 2)]}


# Hard negatives


def mined(rows, positives=5, negatives=10, scale=256):
    kept = [(i, v, l) for i, v, l in rows if i is not None and l is not None and usable(v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    full = [(i, (l + 1) % 10 if i % 7 == 0 else l, floors(v, scale, width)) for i, v, l in kept]
    anchors = {}
    for i, l, v in full:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    out = []
    for a, (l, v) in anchors.items():
        score = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), j, m) for j, m, u in full if j != a)
        for p, j, _ in [s for s in score if s[2] == l][:positives]:
            lost = [(n, k) for n, k, m in score if m != l and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
            limit = lambda n: max(-(2**63), min(2**63 - 1, n))
            out += [(a, j, r + 1, k, limit(-p), limit(-n)) for r, (n, k) in enumerate(lost)]
    return sorted(out)


@pytest.mark.parametrize("rows", [clusters(1500, 12, 9), ODD, [(i, [1.0, float(i % 3), -1.0], i % 2) for i in range(300)], ODD + [(402, [1e130, 1e20, 1e17, 0.0], 2)], ODD + HUGE[:2]], ids=["clusters", "odd", "copies", "long", "huge"])
def test_hard_negatives_are_all_found(spark, rows):
    got = negatives.mine(frame(spark, rows).repartition(4), negatives.label_of())
    found = sorted(map(tuple, got.collect()))
    assert found == mined(rows)


def test_hard_negatives_of_an_empty_table(spark):
    assert negatives.mine(frame(spark, []), negatives.label_of()).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.mine(frame(spark, [(100, [1.0], 0)]), negatives.label_of()).collect() == []
    assert negatives.mine(frame(spark, [(100, [1.0], 0), (101, [1.0], 0)]), negatives.label_of()).collect() == []


def test_annuli_that_cannot_matter_are_skipped(spark):
    """Runs far from every anchor are not scored: the bound of their key interval certifies the result."""
    rng = np.random.default_rng(10)
    rows = [(i, (rng.normal(size=8) * 0.05 + (np.eye(8)[i % 8] * 3)).tolist(), i % 2) for i in range(4000)]
    with scratch(spark):
        kept = negatives.usable(frame(spark, rows), "vec_id", "embedding", F.col("label"))
        stored, points, top = negatives.store(kept, 8, 256)
        asked = [r.asDict() | {"windows": [{"window": 0, "low": None, "high": None, "least": None}]} for r in kept.where("id % 400 = 0").collect()]
        r = negatives.Requests(asked, 8, 256, points, top)
        import pyarrow as pa

        held = list(negatives.runs(iter(pa.Table.from_batches(stored.orderBy("pivot", "d", "id").toArrow().to_batches(max_chunksize=100)).to_batches()), 8, 256))
        tops = [[negatives.Top(5, -math.inf)] for _ in asked]
        scored = negatives.scan(held, r, tops, True, None)
    assert scored < 0.4 * len(asked) * 2000


@pytest.mark.parametrize(("a", "b"), [(-(2**70), -5), (-5, -4), (-1, 0), (0, 1), (255, 256), (2**64, 2**65 + 1), (-(10**400), -(10**399)), (10**399, 10**400)])
def test_scores_of_any_size_sort(a, b):
    assert negatives.sortable(a) < negatives.sortable(b) and negatives.number(negatives.sortable(a)) == a and negatives.number(negatives.sortable(b)) == b
