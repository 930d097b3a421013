"""Linkage of every record with every other one, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.scores import in_del_ratio
from tessera.operators import linkage as L
from tessera.plans import analytics


def brute_pairs(texts, least):
    found = sorted({t for t in texts if t is not None})
    return {(a, b): r for i, a in enumerate(found) for b in found[i + 1 :] if (r := in_del_ratio(a, b)) >= least}


def misspelt(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "x", "é", " ", "e"])
    return "".join(out)


def names(seed, n):
    rng = random.Random(seed)
    words = "old new red blue bolt bolts gear ring éclair straße 東京 a ab".split()
    plain = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(n)]
    short = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(n // 2)]
    return plain + [misspelt(rng, t) for t in plain] + short + ["", None, "aaaaaaaa", "aaaaaaaaa", "zz", "zqz", "x" * 300, "x" * 260 + "y" * 40]


@pytest.mark.parametrize(("least", "block"), [(75.0, 2000), (67.0, 3), (90.0, 7), (100.0, 2000)])
def test_no_similar_pair_escapes(spark, monkeypatch, least, block):
    """Short texts, texts without a common word, common bigrams in many blocks."""
    monkeypatch.setattr(L, "BLOCK", block)
    texts = names(3, 70)
    got = L.similar_texts(spark.createDataFrame([(t, "c") for t in texts + texts[:20]], "p string, g string"), "p", least).collect()
    assert {(r.a, r.b): r.ratio for r in got} == brute_pairs(texts, least) and len(got) == len(brute_pairs(texts, least))


def test_a_ratio_that_bigrams_cannot_promise_is_refused(spark):
    with pytest.raises(ValueError, match="66.7"):
        L.similar_texts(spark.createDataFrame([("a",)], "t string"), "t", 66.0)
    assert L.similar_texts(spark.createDataFrame([], "t string"), "t").collect() == []


def test_common_bigrams_meet_no_more_than_they_must(spark):
    """Texts of one common and one rare word: the rare ones lead, so few pairs are measured."""
    texts = [f"common beginning {i * 7919 % 100_003:05d}" for i in range(300)]
    found = L.similar_texts(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 95.0)
    assert {(r.a, r.b): r.ratio for r in found.collect()} == brute_pairs(texts, 95.0)


def brute_matches(rows, least=75.0):
    step = lambda d: 50 if d is None else next((p for m, p in ((2, 100), (5, 90), (10, 75), (20, 50), (40, 25)) if abs(d) <= m), 0)
    first = {}
    order = lambda v: tuple((x is not None, x) if x is not None else (False,) for x in v)
    for k, *v in rows:
        if k is not None:
            first[k] = min(first.get(k, v), v, key=order)
    out = {}
    for k, (t, a, z, _) in first.items():
        best = None
        for m, (u, b, y, x) in first.items():
            if m == k or t is None or u is None or (r := in_del_ratio(t, u)) < least:
                continue
            like = in_del_ratio(a, b) or 0.0
            score = round(0.7 * r + 0.15 * like + 0.15 * step(None if z is None or y is None else z - y), 6)
            one = (bool(x), score, -m)
            best = one if best is None else max(best, one)
        out[k] = (None, None, "not_found") if best is None else (-best[2], pytest.approx(best[1], abs=2e-6), "no_lyrics" if not best[0] else "matched" if best[1] >= 80 else "review")
    return out


def test_best_match_against_brute_force(spark):
    rng = random.Random(5)
    texts = names(5, 60)
    rows = [(i, rng.choice(texts), rng.choice(["SMALL", "LARGE", "MEDIUM", None]), rng.choice([*range(1, 90, 4), None]), rng.choice([True, True, False, None])) for i in range(60, 300)]
    rows += [(60, "blue gear", "SMALL", 4, True), (None, "old bolt", "SMALL", 3, True), (301, None, "SMALL", 3, True), (302, "pair only", None, 1, False), (303, "pair onlx", None, 9, False), (304, "quite alone here", "LARGE", 9, True)]
    rows += [(i, "hot name", "SMALL", 7, True) for i in range(400, 500)]
    d = spark.createDataFrame([(*r, "c", 1) for r in rows], "k long, t string, a string, z int, x boolean, b string, score int")
    got = {r.k: (r.matched, r.score, r.status) for r in L.best_matches(d.repartition(4), "k", "t", "a", "z", F.col("x")).collect()}
    want = brute_matches(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k
    assert got[400][0] == 401 and got[450][0] == 400 and got[302][2] == "no_lyrics" and got[304][2] == "not_found"


def test_best_match_of_an_empty_table(spark):
    d = spark.createDataFrame([], "k long, t string, a string, z int, x boolean")
    assert L.best_matches(d, "k", "t", "a", "z", F.col("x")).collect() == []


def test_the_query_covers_every_part(spark, sf):
    got = analytics.link_best_match(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/part.parquet").count()
