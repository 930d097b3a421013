"""Rule-based valence against a plain loop, rule by rule and on random texts; DuckDB's twin on the same texts."""

import math
import random
import string

import duckdb
import pytest

from tessera.operators import valence as V

TABLE = {"good": 1.9, "great": 3.1, "bad": -2.5, "hate": -2.7, "love": 3.2, "kind": 2.4, "least": -0.5}


def plain(text):
    w = []
    for x in (text or "").split():
        y = x.strip(string.punctuation)
        w.append(y if len(y) > 2 else x)
    if not w:
        return (None,) * 4
    low = [x.lower() for x in w]
    mixed = 0 < sum(x.isupper() for x in w) < len(w)
    negated = lambda x: x in V.NEGATIONS or "n't" in x
    found = []
    for i, x in enumerate(low):
        if x in V.BOOSTERS or x in V.DAMPERS or low[i : i + 2] == ["kind", "of"]:
            found.append(0.0)
            continue
        v = TABLE.get(x, 0.0)
        if v and mixed and w[i].isupper():
            v += math.copysign(0.733, v)
        for back in (1, 2, 3):
            if not v or i < back or low[i - back] in TABLE:
                continue
            p = low[i - back]
            s = 0.293 if p in V.BOOSTERS else -0.293 if p in V.DAMPERS else 0.0
            if s and mixed and w[i - back].isupper():
                s += 0.733
            v += math.copysign(1, v) * s * (1, 0.95, 0.9)[back - 1]
            between = low[i - back + 1 : i]
            if back > 1 and p == "never" and {"so", "this"} & set(between):
                v *= (1.5, 1.25)[back - 2]
            elif back > 1 and p == "without" and "doubt" in between:
                pass
            elif negated(p):
                v *= -0.74
        if i and low[i - 1] == "least" and "least" not in TABLE and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= -0.74
        found.append(v)
    if "but" in low:
        at = low.index("but")
        found = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in enumerate(found)]
    asks = text.count("?")
    marks = min(text.count("!"), 4) * 0.292 + (0 if asks < 2 else asks * 0.18 if asks <= 3 else 0.96)
    total = sum(found)
    total += math.copysign(marks, total) if total else 0
    p, q, z = sum(v + 1 for v in found if v > 0), sum(1 - v for v in found if v < 0), found.count(0.0)
    p, q = (p + marks, q) if p > q else (p, q + marks) if q > p else (p, q)
    all_ = p + q + z
    return p / all_, q / all_, z / all_, total / math.sqrt(total * total + 15)


def texts():
    r = random.Random(5)
    vocabulary = [*TABLE, "very", "SLIGHTLY", "never", "so", "this", "isn't", "not", "but", "without", "doubt", "at", "of", "the", "dog", "GOOD", "HATE", "Bad,", "good!!", "why??", "(love)", "é", ":)", "NO"]
    made = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 14))) for _ in range(250)]
    return ["good", "not good", "very good", "slightly GOOD dog", "never so good", "never was this good", "without doubt good", "kind of good", "bad but great", "good!!!!! why????", "least good", " \t\n", "", None, "dog " * 30_000 + "love", *made]


def close(got, wanted):
    return all(a is b is None or (a is not None and b is not None and abs(a - b) <= e) for a, b, e in zip(got, wanted, (6e-4, 6e-4, 6e-4, 6e-5), strict=True))


@pytest.fixture(scope="module")
def made():
    return list(enumerate(texts()))


def test_rules_as_by_a_plain_loop(spark, made):
    table = spark.createDataFrame([*TABLE.items(), ("GOOD", 1.9), (None, 1.0), ("dog", None)], "token string, valence double")
    df = spark.createDataFrame([(i, t, 1.0) for i, t in made], "key long, t string, valence double")
    got = {r.id: (r.positive, r.negative, r.neutral, r.compound) for r in V.valence(df, "key", "t", table).collect()}
    assert len(got) == len(made)
    wrong = [(t, got[i], plain(t)) for i, t in made if not close(got[i], plain(t))]
    assert not wrong, wrong[:3]
    assert V.valence(df.limit(0), "key", "t", table).collect() == []
    assert {r.compound for r in V.valence(df.where("key < 3"), "key", "t", table.limit(0)).collect()} == {0.0}


def test_large_tables_shuffle_and_least(spark, monkeypatch):
    monkeypatch.setattr(V, "BROADCAST_TOKENS", 1)
    df = spark.createDataFrame([(1, "least good day"), (2, "at least good"), (3, "a very good day"), (4, "dull")], "key long, t string")
    table = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    got = {r.id: r.compound for r in V.valence(df, "key", "t", table).collect()}
    assert got[1] < 0 < got[2] < got[3] and got[4] == 0


def test_the_sql_twin(made):
    c = duckdb.connect()
    c.sql("create table d (k bigint, t varchar)")
    c.executemany("insert into d values (?, ?)", [(i, t) for i, t in made if not t or len(t) < 1000])
    got = {r[0]: r[1:] for r in c.sql(V.sql("d", "k", "t", TABLE)).fetchall()}
    assert not [(t, got[i], plain(t)) for i, t in made if i in got and not close(got[i], plain(t))]
