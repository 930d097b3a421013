import math

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scores import estimate_key, in_del_ratio
from tessera.plans.relational import step_score

SAMPLE = "Numb. I can't\nfeel, I can't feel!\n\nfeel"


def one(spark, value, **columns):
    return spark.createDataFrame([(value,)], "t string").select(*(c.alias(n) for n, c in columns.items())).first()


def test_tokens_sentences_lines(spark):
    r = one(spark, SAMPLE, w=T.tokens("t"), s=T.sentences("t"), n=T.lines("t"))
    assert r.w == ["numb", "i", "can't", "feel", "i", "can't", "feel", "feel"]
    assert r.s == ["Numb.", "I can't", "feel, I can't feel!", "feel"]
    assert len(r.n) == 3


def test_lexical(spark):
    r = spark.createDataFrame([(SAMPLE,)], "t string").select(T.tokens("t").alias("w")).select(*(c.alias(n) for n, c in T.lexical("w").items())).first()
    assert (r.word_count, r.unique_word_count, r.repeated_word_occurrences) == (8, 4, 4)
    assert math.isclose(r.root_type_token_ratio, 1.414214, abs_tol=1e-6) and r.type_token_ratio == 0.5 and math.isclose(r.corrected_type_token_ratio, 1.0)
    assert r.mean_word_length == 3.5 and math.isclose(r.std_word_length, 1.5) and r.lexical_density_proxy == 0.75


def test_empty_and_null_text(spark):
    for value in ("", None):
        r = spark.createDataFrame([(value,)], "t string").select(T.tokens("t").alias("w"), T.clean_lines("t").alias("c"), T.sentences("t").alias("s")).select("c", "s", *(c.alias(n) for n, c in T.lexical("w").items())).first()
        assert r.c == "" and r.s == [] and r.word_count == 0 and r.type_token_ratio == 0.0


def test_syllables(spark):
    words = {"the": 1, "time": 1, "table": 2, "people": 2, "broken": 2, "rhythm": 1, "idea": 2}
    for w, n in words.items():
        assert one(spark, w, n=T.syllables(F.col("t"))).n == n, w


def test_cleaning(spark):
    raw = "[00:12.30] Hello\n[Chorus]\nLyrics: X\n\n\n\n(whisper)\nworld"
    assert one(spark, raw, c=T.clean_lines("t")).c == "Hello\n\n(whisper)\nworld"


def test_titles(spark):
    wanted = {"Song One (Live at Venue)": "Song One", "Song Two - Remastered 2012": "Song Two", "Song Three (Reprise)": "Song Three (Reprise)"}
    for t, c in wanted.items():
        assert one(spark, t, c=T.canonical_title("t")).c == c
    assert one(spark, "A & B_c!", m=T.match_title("t"), s=T.slug("t"), k=T.song_key("t")) == ("a and b c", "a-and-b-c", "abc")
    assert one(spark, "!!", s=T.slug("t", "x")).s == "x"
    r = one(spark, "Song (Demo)", **T.version_flags("t"))
    assert r.is_demo and not r.is_original and not one(spark, None, **T.version_flags("t")).is_live


def test_fuzzy_ratio():
    assert math.isclose(in_del_ratio("kitten", "sitting"), 61.538462, abs_tol=1e-6)
    assert math.isclose(in_del_ratio("small ring", "small rings"), 95.238095, abs_tol=1e-6)
    assert in_del_ratio("", "") == 100.0 and in_del_ratio(None, "a") is None and in_del_ratio("", "a") == 0.0


def test_fuzzy_ratio_against_plain_programming():
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        want = 100.0 if not a and not b else 200 * lcs(a, b) / (len(a) + len(b))
        assert math.isclose(in_del_ratio(a, b), want)


def test_step_score(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (2.0, 2.01, 5.0, 10.0, 20.0, 40.0, 40.01, None)], "x double").select(step_score(F.col("x"))).collect()]
    assert got == [100, 90, 90, 75, 50, 25, 0, 50]


def test_musical_key(spark):
    from tessera.functions.scores import MAJOR

    turned = [MAJOR[(i - 9) % 12] for i in range(12)]
    df = spark.createDataFrame([(1, turned), (2, [1.0] * 12)], "id int, c array<double>")
    got = {r.id: (r.key, r.mode, r.confidence) for r in estimate_key(df, "id", "c").collect()}
    assert got == {1: ("A", "major", 1.0), 2: (None, None, None)}


def test_compatible_composition_of_every_character(spark):
    """All code points that Python's tables know, one by one and before a combining mark; null and ASCII as they are."""
    import unicodedata

    known = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and unicodedata.category(chr(i)) != "Cn"]
    d = spark.createDataFrame([(a,) for a in known[:70_000] + known[-40_000:] + [f"{c}̣́" for c in known[:30_000]]], "c string")
    assert [(r.c, r.n) for r in d.select("c", T.compatible("c").alias("n")).collect() if r.n != unicodedata.normalize("NFKC", r.c)] == []
    odd = spark.createDataFrame([(None,), ("",), ("it's",), ("ﬁne … “½”",)], "c string")
    assert [r[0] for r in odd.select(T.plain_punctuation("c")).collect()] == [None, "", "it's", 'fine ... "1⁄2"']
