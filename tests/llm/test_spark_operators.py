"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, fmindex, html, jaccard, lm, maxscore, quality, queries, substrings, toxicity, urls
from tessera.llm.common import alnum_words, arrow_map, space_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like whatever the operators use inside.
CLASH = ["id", "n", "s", "k", "rank", "score", "component", "hub", "ids", "decoded", "removed", "hit_words", "item_ids", "quality", "toxicity", "_text", "units", "point", "prefix"]
WORDS = "the an river ther stone light er walk on green it was house with field over road tion ing es".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n)).capitalize() + "."


def prose(rng, sentences):
    return " ".join(sentence(rng, rng.randint(5, 14)) for _ in range(sentences))


def corpus():
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(1, 12))) for i in range(60)]
    base = prose(rng, 12)
    for i in range(60, 90):  # near copies of one text, some alike, some further away
        w = base.split()
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    passage = prose(rng, 8)
    rows += [(i, prose(rng, 2) + " " + passage + " " + prose(rng, 2)) for i in range(90, 100)]
    rows += [(i, rows[3][1]) for i in range(100, 110)]
    rows += [(110, None), (111, ""), (112, "  \n\t "), (113, "Two words"), (114, "two WORDS"), (115, "one two three four five"), (116, "One Two Three Four Five"), (117, "x" * 30_000), (118, "word " * 20_000), (119, prose(rng, 1500))]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(docs):
    """With rows repeated, a null key, and clashing columns."""
    more = docs.where("doc_id in (3, 70, 110)").unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    return docs.unionByName(more).withColumns({c: F.lit(7).cast("long") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def text_set(text):
    w = space_words((text or "").encode())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets = {r[0]: text_set(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("bucket", [2048, 8])
def test_groups_against_brute_force(docs, rows, monkeypatch, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs).collect()}
    assert got == brute_groups(rows)


def test_groups_of_one_key_with_different_texts(spark):
    """The key is one document: it links what either of its texts is similar to."""
    rng = random.Random(17)
    a, b = prose(rng, 12), prose(rng, 12)
    near = lambda t: t + " one more sentence"
    d = spark.createDataFrame([(1, a), (2, a), (2, b), (3, near(b)), (4, near(a)), (5, prose(rng, 12)), (5, "alone")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.groups(d).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    with pytest.raises(TypeError):
        jaccard.groups(d.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_groups_of_odd_tables(odd, docs, empty):
    want = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs).collect()}
    got = jaccard.groups(odd).collect()
    assert len(got) == odd.count()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.groups(empty).collect() == [] and jaccard.keep_one(empty).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c} | {None}


def brute_repeats(rows):
    first = {}
    for i, t in sorted(rows):
        for k, (_, unit, n) in enumerate(substrings.units(t or "")):
            if n >= substrings.TINY:
                first.setdefault(unit, (i, k))
    out = {}
    for i, t in rows:
        found = [k for k, (_, unit, n) in enumerate(substrings.units(t or "")) if n >= substrings.TINY and first[unit] != (i, k)]
        out[i] = substrings.removal(t, found) if found else []
    return out


def test_repeats_against_brute_force(docs, rows):
    want = brute_repeats([(r[0], r[1]) for r in rows])
    texts = {r[0]: r[1] for r in rows}
    for r in substrings.remove_repeats(docs).collect():
        spans = [(x.start, x.end) for x in r.removed]
        assert spans == want[r.doc_id]
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + texts[r.doc_id][at:a], b
        assert r.text == (None if texts[r.doc_id] is None else kept + texts[r.doc_id][at:]) and r.n_chars == len(r.text or "")
    assert want[100] and not want[3]


def test_repeats_of_odd_tables(odd, docs, empty):
    want = {r.doc_id: r.text for r in substrings.remove_repeats(docs).collect()}
    got = substrings.remove_repeats(odd)
    assert [c for c in got.columns if c != "removed"] == [c for c in odd.columns if c != "removed"]
    got = got.collect()
    assert len(got) == odd.count() and all(r.text == want[r.doc_id] for r in got if r.doc_id is not None)
    assert substrings.remove_repeats(empty).count() == 0


def test_repeats_of_one_key_with_different_texts(spark):
    """A text that no one shares stays whole, whatever other rows of its key lose."""
    rng = random.Random(31)
    a, b, c = prose(rng, 8), prose(rng, 9), prose(rng, 7)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c + "\n" + b), (4, None), (4, "")]
    for schema, name in (("doc_id long, text string", int), ("doc_id string, text string", str)):
        d = spark.createDataFrame([(name(i), t) for i, t in rows], schema)
        got = sorted(((r.doc_id, r.text, len(r.removed)) for r in substrings.remove_repeats(d).collect()), key=str)
        assert got == sorted([(name(1), a, 0), (name(2), "", 1), (name(2), b, 0), (name(2), b, 0), (name(3), c + "\n", 1), (name(4), None, 0), (name(4), "", 0)], key=str)


def test_repeats_with_few_remembered_digests(docs, rows, monkeypatch):
    monkeypatch.setattr(substrings, "RECENT", 4)
    want = brute_repeats([(r[0], r[1]) for r in rows])
    assert {r.doc_id: [(x.start, x.end) for x in r.removed] for r in substrings.remove_repeats(docs.repartition(2).withColumn("n_chars", F.lit("many"))).collect()} == want


BENCH = "item_id long, text string"


@pytest.mark.parametrize("items", [20_000, 1])
def test_phrases_of_one_key_with_different_texts(spark, monkeypatch, items):
    monkeypatch.setattr(fmindex, "BLOCK_ITEMS", items)
    rng = random.Random(32)
    long, tail = prose(rng, 6), prose(rng, 2)
    d = spark.createDataFrame([(1, tail), (2, long + " " + tail), (2, "short one"), (2, "short one"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, long), (8, "another " + long), (9, "not here")], BENCH)
    found = sorted((r.doc_id, r.n_words, r.item_ids) for r in fmindex.find_phrases(d, b).collect())
    assert found == sorted([(1, len(alnum_words(tail.encode())), []), (2, len(alnum_words((long + " " + tail).encode())), [7, 8]), (2, 2, []), (2, 2, []), (2, 0, [])])
    cut = [(r.doc_id, (r.text or "None").strip()) for r in fmindex.remove_phrases(d, b).collect()]
    assert sorted(cut) == sorted([(1, tail), (2, tail), (2, "short one"), (2, "short one"), (2, "None")])


def test_phrases_in_blocks(spark, docs, rows, monkeypatch):
    texts = {r[0]: r[1] for r in rows}
    bench = [(1, texts[7]), (2, texts[8]), (3, texts[8]), (4, "two words"), (5, None), (6, "!!"), (7, "nowhere to be found at all in these texts my dear"), (8, texts[119])]
    b = spark.createDataFrame(bench, BENCH)
    items = [(i, (t or "").encode()) for i, t in bench]
    whole = {r.doc_id: r for r in fmindex.find_phrases(docs, b).collect()}
    phrases = fmindex.Phrases(items, 10)
    for i, t, *_ in rows:
        words = alnum_words((t or "").encode())
        by_first = defaultdict(list)
        for p, k in zip(phrases.words, range(len(phrases.words)), strict=True):
            by_first[p[0]].append((p, k))
        ids = [phrases.ids.get(w, 0) for w in words]
        hit, found = set(), set()
        for at, w in enumerate(ids):
            for p, k in by_first.get(w, ()):
                if tuple(ids[at : at + len(p)]) == p:
                    hit.update(range(at, at + len(p)))
                    found.update(phrases.items[k])
        r = whole[i]
        assert r.n_words == len(words) and r.item_ids == sorted(found)
        assert {x for s in r.hit_words for x in range(s.start, s.end)} == hit
    assert whole[8].item_ids == [2, 3] and whole[114].item_ids == [4] and whole[113].item_ids == [4]
    monkeypatch.setattr(fmindex, "BLOCK_ITEMS", 3)
    parts = {r.doc_id: r for r in fmindex.find_phrases(docs, b).collect()}
    assert {i: (r.n_words, r.hit_words, r.item_ids) for i, r in parts.items()} == {i: (r.n_words, r.hit_words, r.item_ids) for i, r in whole.items()}


def test_phrases_of_odd_tables(spark, odd, empty, rows):
    b = spark.createDataFrame([(1, rows[7][1]), (None, "x"), (2, "two words")], BENCH)
    cut = fmindex.remove_phrases(odd, b)
    assert cut.columns == odd.columns
    by = {r.doc_id: r for r in cut.collect()}
    assert by[7].text.strip() == "" and by[113].text == "" and by[8].text == rows[8][1] and by[110].text is None and cut.count() == odd.count()
    assert fmindex.remove_phrases(empty, b).count() == 0
    none = fmindex.report(fmindex.find_phrases(odd, b.limit(0)))
    assert none.where("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert none.first().items_sha256 == hashlib.sha256(b"").hexdigest()


def test_bpe_on_tables(odd, docs, empty, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    got = bpe.encode_decode(odd, queries.vocabulary())
    assert set(got.columns) == set(odd.columns) and got.count() == odd.count()
    texts = {r[0]: r[1] or "" for r in rows}
    for r in bpe.digests(bpe.encode_decode(docs, queries.vocabulary())).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(empty, queries.vocabulary()).count() == 0


def test_workers_keep_no_encoder_for_other_operators(spark, docs):
    """The words that a worker keeps encoded would otherwise stand beside all that later operators hold."""

    def encoders(batches):
        import gc

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "WordBpe" for x in gc.get_objects())])], ["n"])

    bpe.encode_decode(docs.repartition(8), queries.vocabulary()).count()
    assert arrow_map(spark.range(64).repartition(8), encoders, "n long").agg(F.sum("n")).first()[0] == 0


def test_lm_on_tables(docs, odd, empty, rows):
    out = {r.doc_id: r for r in lm.report(docs).collect()}
    words = {r[0]: space_words((r[1] or "").encode()) for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts, ends = Counter(), 0
    for i, w in words.items():
        if not held[i]:
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, w in words.items():
        r = out[i]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(x in counts for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lm.report(odd).count() == odd.count()
    assert lm.report(empty).count() == 0
    lone = lm.report(docs.where("doc_id = 110")).first()
    assert lone.n_tokens == 1 and math.isfinite(lone.score) and math.isfinite(lone.base_score)


def test_lm_words_beyond_the_dictionary(docs, monkeypatch):
    whole = {r.doc_id: (r.n_known, r.base_score) for r in lm.report(docs).collect()}
    monkeypatch.setattr(lm, "DICTIONARY", 30)
    monkeypatch.setattr(lm, "COUNTED", 20)
    small = {r.doc_id: (r.n_known, r.base_score) for r in lm.report(docs).collect()}
    assert all(whole[i][0] == small[i][0] and math.isclose(whole[i][1], small[i][1], rel_tol=1e-9) for i in whole)


def test_lm_is_a_distribution(spark, docs, monkeypatch):
    """Over the dictionary's words, one unknown word a class and the end, the next-word probabilities sum to 1."""
    monkeypatch.setattr(lm, "MIN_COUNT", 5)
    source = docs.where("doc_id < 60").select(F.col("text").cast("binary").alias("_text"))
    m, counts = lm.train(source)
    units = lm.Units(m.words, m.clustered)
    at, unit, _ = units(m.words)
    group, end = m.group[unit], len(m.step) - 1
    assert m.clustered > 20 and set(m.group[:-1]) <= set(range(end)) and m.group[-1] == end
    for before in (end, int(group[0]), int(group[-1])):
        known = sum(10 ** (m.step[before, g] + m.log_count[i] - m.below[g]) for i, g in zip(at.tolist(), group.tolist(), strict=True))
        unknown = sum(10 ** (m.step[before, g] + m.log_count[-1] - m.below[g]) for g in range(end))
        assert math.isclose(known + unknown + 10 ** m.step[before, end], 1.0, rel_tol=1e-9)


def test_lm_scores_by_plain_python(docs, rows, monkeypatch):
    """Given the classes, every count and probability again from the texts; and the classes beat having only one."""
    monkeypatch.setattr(lm, "MIN_COUNT", 5)
    monkeypatch.setattr(lm, "PAIRED", 3000)
    source = docs.select("doc_id", F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    m, counts = lm.train(source.where("doc_id < 100").select("_text"))
    got = {r.doc_id: r.score for r in lm.score(source, m, counts, "doc_id").collect()}
    texts = {r[0]: space_words((r[1] or "").encode()) for r in rows}
    seen = Counter(w for i, t in texts.items() if i < 100 for w in t)
    own = {w: i for i, w in enumerate(m.words[: m.clustered])}
    end = len(m.step) - 1
    assert all(seen[w] >= 5 for w in own) and end >= 2
    of = lambda w: int(m.group[own[w] if w in own else m.clustered + zlib.crc32(w[-3:]) % lm.SUFFIXES])
    steps, size, kinds = Counter(), Counter(), Counter()
    for w, n in seen.items():
        size[of(w)] += n
        kinds[of(w)] += 1
    for i, t in texts.items():
        if i < 100:
            path = [end, *map(of, t), end]
            steps.update(zip(path, path[1:], strict=False))
            size[end] += 1
    everything = sum(size.values())

    def plain(t, of):
        path, total = [end, *map(of, t), end], 0.0
        for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
            share = (size[b] + 0.5) / (everything + 0.5 * (end + 1))
            total += math.log10((steps[a, b] + lm.TRANSITION * share) / (sum(steps[a, x] for x in range(end + 1)) + lm.TRANSITION))
            if k < len(t):
                total += math.log10((seen[t[k]] + lm.DELTA) / (size[b] + lm.DELTA * (kinds[b] + 1)))
        return total

    for i in [*range(0, 117, 9), 112, 119]:
        assert math.isclose(got[i], plain(texts[i], of), rel_tol=1e-6), i


def test_exchange_sweeps_separate_two_languages(spark):
    """Two vocabularies that never meet inside a text: no class but the rare words' holds words of both."""
    rng = random.Random(23)
    voc = [[f"{x}{i}" for i in range(60)] for x in ("north", "south")]
    texts = [(" ".join(rng.choices(v, k=200)).encode(),) for v in voc for _ in range(60)]
    m, _ = lm.train(spark.createDataFrame(texts, "_text binary").repartition(3))
    assert m.clustered == 120
    mixed = sum(1 for g in set(m.group[:120].tolist()) if len({m.words[i][:1] for i in range(120) if m.group[i] == g}) > 1)
    assert mixed == 0


def test_quality_and_toxicity_on_tables(spark, odd, empty):
    judged = quality.judge(odd)
    assert judged.count() == odd.count() and set(judged.columns) == set(odd.columns)
    assert judged.where("quality is null or quality < 0 or quality > 1").count() == 0
    assert quality.judge(empty).count() == 0
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)] + [(3, 1, 1), (None, 1, 1), (9999, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.report(odd, labels)
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    same = out.where("doc_id in (3, 100, 105)").select("score").distinct()
    assert same.count() == 1
    assert toxicity.report(empty, labels).count() == 0
    assert toxicity.report(odd, labels.limit(0)).where("predicted <> 0 or score > 0.01").count() == 0


def test_quality_by_plain_python(docs, rows):
    """All votes, the posteriors, the scorer and every score again, without Spark."""
    texts = [r[1] for r in rows]
    vote = quality.Voter()
    belief = quality.weigh(list(Counter(map(vote, texts)).items()))
    fits = sorted((t for t in texts if len(t or "") <= quality.SAMPLE_CHARS), key=lambda t: t or "")
    w = quality.fit([(t, belief[vote(t)]) for t in fits])
    got = {r.doc_id: r.quality for r in quality.judge(docs).collect()}
    for i, t, *_ in rows:
        assert math.isclose(got[i], 1 / (1 + math.exp(-float(quality.Hashed()(t) @ w[:-1] + w[-1]))), abs_tol=1e-4), i


def test_toxicity_by_plain_python(spark):
    """The query's scores from the model's table by the kernel's definition, word by word."""
    rng = random.Random(33)
    rows = [(i, prose(rng, 2) + (" grumpfig zwackelorx" if i % 3 == 0 else "") + (" z w a c k" if i == 7 else "")) for i in range(90)] + [(90, None), (91, "")]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in toxicity.report(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    model = toxicity.fit([(t, y) for (i, t), (_, _, y) in zip(rows, labels, strict=False) if not held(i)])

    def margin(word):
        c, total, square = toxicity.symbols(word), 0.0, 0.0
        for i in range(len(c)):
            for k in range(i + 2, min(len(c), i + toxicity.SPAN)):
                for j in range(i + 1, k):
                    total += toxicity.DECAY ** (k - i + 1) * float(model.table[(c[i] * toxicity.SYMBOLS + c[j]) * toxicity.SYMBOLS + c[k]])
                    square += toxicity.DECAY ** (2 * (k - i + 1))
        return total / max(1e-9, math.sqrt(square)) + model.bias

    for i, t in rows:
        words = {w for w in (toxicity.plain(x) for x in toxicity.tokens(t or "")) if len(w) > 1}
        top = sorted((max(margin(w), toxicity.LOWEST) for w in words), reverse=True) + [toxicity.LOWEST] * 2
        want = model.probability(top[0], top[1])
        assert math.isclose(got[i][0], want, abs_tol=1e-3) and got[i][1:] == (int(got[i][0] >= 0.7), held(i)), i


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(12)
    insults = ["grumpfig", "zwackelor"]
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, 4).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(insults) + rng.choice(["", "en", "x"]))
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    out = toxicity.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in out)
    assert right >= 0.97 * len(out)


VECTORS = "vec_id long, embedding array<float>, label int, score long"


def test_top_k_on_tables(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], 0, 1) for i in range(250)]
    rows += [(300, None, 0, 1), (400, [], 0, 1), (500, [1.0, None] + [0.0] * 4, 0, 1), (600, [float("nan")] * 6, 0, 1), (700, [float("inf")] * 6, 0, 1), (None, [0.5] * 6, 0, 1), (800, rows[4][1], 0, 1), (801, rows[4][1], 0, 1)]
    rows += [(900, [2.0**41, -1.0, 0.5], 0, 1), (901, [-(2.0**41), 3.0], 0, 1), (1000, [1e30] * 6, 0, 1), (1001, [-1e30] * 6, 0, 1)]
    d = spark.createDataFrame(rows, VECTORS)
    import numpy as np

    whole = lambda v: [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (6 - len(v))
    good = {i: whole(v) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(good):
        if q % 100 == 0:
            score = {c: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(good[q], good[c], strict=True)))) for c in good if c != q}
            best = sorted((-s, c) for c, s in score.items())[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert {400, 900, 1000} <= {r[0] for r in want} and any(abs(r[3]) > 2**53 for r in want)
    take = lambda: sorted(tuple(r) for r in maxscore.top_k(d.repartition(4)).collect())
    assert take() == sorted(want)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 2)
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 16)
    assert take() == sorted(want)
    assert maxscore.top_k(d.limit(0)).count() == 0
    few = maxscore.top_k(d.where("vec_id in (0, 1, 2)")).collect()
    assert len(few) == 2


def test_top_k_of_huge_components_and_other_keys(spark):
    rows = [("0", [1.0, 2.0]), ("100", [1e306, -3.5]), ("7", [1e300, 4.0]), ("8", [-1e306, 0.25]), ("9", [0.5, 1e17]), ("none", [9.0, 9.0]), (None, [9.0, 9.0])]
    got = {}
    for r in maxscore.top_k(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = {int(k): [int(x) * 1024 if abs(x) > 1e300 else math.floor(1024 * x) for x in v] for k, v in rows if k not in (None, "none")}
    for q in (0, 100):
        score = {c: sum(a * b for a, b in zip(whole[q], v, strict=True)) for c, v in whole.items() if c != q}
        best = sorted((max(-(2**63), min(2**63 - 1, s)), -c) for c, s in score.items())[::-1]
        assert got[q] == [(-c, s) for s, c in best]


def test_urls_on_tables(spark):
    rows = [(1, None), (2, "abc"), (3, "HTTP://A.Example.COM/en/77?x"), (4, "http://example.net/de/81"), (5, "x://com/en/"), (6, "x://notcom/en/"), (7, "http://a.org"), (8, "http://b.org/es/#"), (9, ""), (10, "http://example.com/en/7://"), (11, "http://cheap-pills.example.org/x"), (12, "http://É.ORG/es/" + "a" * 5000)]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    w = urls.train(urls.labelled_urls(spark))

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest[: min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])]
        path = rest[len(host) :]
        path = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for r, v in urls.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
        best = max(fits) if fits else None
        return host, path, best and best[1], best and best[2]

    got = {r.page_id: r for r in urls.judge(d, w).collect()}
    for i, url in rows:
        host, path, rule, verdict = plain(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))
    assert got[11].verdict == "block" and got[7].verdict == "allow" and got[1].verdict == "allow"
    many = [*urls.RULES, *((f"r{i}.zz/", "block") for i in range(300))]
    assert sorted(map(tuple, urls.judge(d, w, many).collect()), key=str) == sorted(map(tuple, got.values()), key=str)
    assert urls.judge(d.limit(0), w).count() == 0


def plain_buckets(host, path):
    """The n-grams' buckets by another xxHash: the tag's hash seeds the gram's."""
    import re

    import xxhash

    out = set()
    for tag, text, sizes in (("h", f"^{host}$", (3, 4, 5)), ("p", re.sub("[0-9]", "0", f"^{path}$"), (3, 4))):
        for n in sizes:
            for i in range(max(1, len(text) - n + 1)):
                h = xxhash.xxh64_intdigest(text[i : i + n].encode(), xxhash.xxh64_intdigest(tag.encode(), 42))
                out.add((h - (1 << 64) if h >> 63 else h) % urls.BUCKETS)
    return out


def test_url_scores_by_plain_python(spark, sf):
    w = urls.train(urls.labelled_urls(spark))
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = urls.judge(pages, w).collect()
    assert len(rows) == pages.count()
    for r in rows:
        b = plain_buckets(r.host, r.path)
        score = 1 / (1 + math.exp(-(sum(float(f"{w[i]:.9g}") for i in b) / math.sqrt(len(b)) + w[-1])))
        assert math.isclose(r.score, score, abs_tol=2e-6)
        assert r.rule is not None or r.verdict == ("block" if score >= 0.5 else "allow")


def test_url_model_on_hosts_it_has_not_seen(spark, sf):
    """The test pages' hosts, none of which stands in the table, and every fifth row of the table when left out of it."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("url").unionByName(spark.createDataFrame([(f"http://{h}.example.org/en/5",) for h in "spam-farm cheap-pills casino-win free-bets ads-track adult-x".split()], "url string"))
    stem = F.regexp_replace(F.regexp_replace("host", "^(www|m|blog)[.]", ""), "[.]example[.](com|net|org)$", "")
    seen = {r[0] for r in urls.parts(pages, "url").select(stem).distinct().collect()} - {""}
    assert not seen & {*urls.BLOCKED_WORDS, *urls.ALLOWED_WORDS}
    w = urls.train(urls.labelled_urls(spark))
    judged = urls.judge(pages.withColumn("page_id", F.lit(0)), w).where("rule is null and host <> ''").select(stem.alias("stem"), "verdict").distinct().collect()
    bad = {r.stem for r in judged if r.verdict == "block"}
    assert bad == {s for s in seen if s in set("spam-farm cheap-pills casino-win free-bets ads-track adult-x".split())}
    table = urls.labelled_urls(spark).withColumn("held", F.pmod(F.xxhash64(F.regexp_extract("url", "//(?:www[.]|m[.]|blog[.])?([a-z]+)", 1)), F.lit(5)) == 0)
    w = urls.train(table.where("not held"))
    held = urls.judge(table.where("held").withColumn("page_id", F.col("blocked")), w, rules=[]).collect()
    right = sum((r.verdict == "block") == (r.page_id == 1) for r in held)
    assert len(held) > 50 and right >= 0.8 * len(held), (right, len(held))


def test_pages_on_tables(spark):
    d = spark.createDataFrame([(1, "u", None, 1), (2, "u", "", 1), (2, "u", "", 1), (3, None, "<article><p>A &eacute;</p><p>b</p></article>", 1)], "page_id long, url string, html string, n_chars long")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(d).collect())
    assert got == [(1, "", 0), (2, "", 0), (2, "", 0), (3, "A é\nb", 5)]
    assert html.extract(d.limit(0)).count() == 0


def test_pipeline_against_its_parts_by_brute_force(spark, tmp_path):
    """The stages' rows, each recomputed by plain Python from what its predecessor kept."""
    import corpus_pipeline as P

    rng = random.Random(21)
    rows = corpus()[:117]
    labels = []
    for i in range(200, 260):
        t = prose(rng, 5).split()
        if i % 2:
            t.insert(3, "grumpfig")
            t.insert(9, "zwackelor")
        rows.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 1, i % 2))
    bench = [(1, rows[7][1]), (2, "a phrase that stands nowhere in these texts at all ever")]
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, BENCH)):
        spark.createDataFrame(data, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    sf = f"file://{tmp_path}"
    out = {r.doc_id: r for r in P.run(spark, sf).collect()}

    model = toxicity.fit([(r[1], dict((a, c) for a, _, c in labels)[r[0]]) for r in rows if r[0] >= 200 and zlib.crc32(str(r[0]).encode()) % 3 != 1])
    probability = lambda t: model.probability(*toxicity._top_two(model.margins(toxicity.words_of(t or ""))))
    kept = [(r[0], r[1]) for r in rows if probability(r[1]) < toxicity.THRESHOLD]
    assert sum(r[0] >= 200 and r[0] % 2 == 1 for r in kept) <= 2
    group = brute_groups(kept)
    kept = [(i, t) for i, t in kept if group[i][1] == i]
    spans = brute_repeats(kept)
    after = []
    for i, t in kept:
        text, at = "", 0
        for a, b in spans[i]:
            text, at = text + t[at:a], b
        after.append((i, t if t is None else text + t[at:]))
    phrases = fmindex.Phrases([(i, t.encode()) for i, t in bench], 10)
    windows = set(phrases.words)
    final = {}
    for i, t in after:
        ids = [phrases.ids.get(w, 0) for w in alnum_words((t or "").encode())]
        hit = sorted({x for at in range(len(ids)) for p in windows if tuple(ids[at : at + len(p)]) == p for x in range(at, at + len(p))})
        cut = fmindex._merged(__import__("numpy").array(hit, int))
        final[i] = fmindex.cut_words(t, [{"start": a, "end": b} for a, b in cut])
    assert {i: r.text for i, r in out.items()} == final
    encoder = bpe.WordBpe(json.load(open(queries.vocabulary())))
    assert all(list(r.ids) == encoder.encode(r.text or "") and r.decoded == encoder.decode(r.ids) for r in out.values())
    assert final[7] is not None and len(final[7]) < len(rows[7][1])


def test_every_stage_takes_odd_and_empty_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline as P

    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", BENCH)):
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        for table in (odd, empty):
            got = stage(spark, table, f"file://{tmp_path}")
            assert got.count() <= table.count()
            if k < len(P.STAGES) - 1:
                assert got.columns == table.columns


def test_queries_run_on_the_small_tables(spark, sf):
    for name, query in queries.QUERIES.items():
        assert query(spark, sf).count() > 0, name
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_html_of_all_test_pages(sf):
    import re

    p = pd.read_parquet(f"{sf}/pages.parquet")
    import html as H

    for page in p.html:
        a = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = "\n".join(x for x in (" ".join(H.unescape(re.sub(r"<[^>]+>", "", y)).split()) for y in re.split(r"</?(?:p|h1)>", a.replace("<br>", " "))) if x)
        assert html.main_text(page) == want


@pytest.mark.parametrize("blocks", [20_000, 1])
def test_items_of_any_id_are_found(spark, monkeypatch, blocks):
    monkeypatch.setattr(fmindex, "BLOCK_ITEMS", blocks)
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([("mmlu-1", " ".join(words[:12])), (None, " ".join(words[12:24])), (None, " ".join(words[13:25])), ("b,2", " ".join(words[20:32])), ("10", "no such text")], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[12:24])), (3, "nothing here")], "doc_id long, text string")
    found = {r.doc_id: r for r in fmindex.find_phrases(docs, bench).collect()}
    assert found[1].item_ids == [None, "b,2", "mmlu-1"] and found[2].item_ids == [None] and found[3].item_ids == []
    told = {r.doc_id: r for r in fmindex.report(fmindex.find_phrases(docs, bench)).collect()}
    assert (told[2].n_hit, told[2].n_items, told[2].contaminated) == (12, 1, True) and told[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert told[1].items_sha256 == hashlib.sha256(b"b,2,mmlu-1").hexdigest() and not told[3].contaminated
    assert [r.text for r in fmindex.remove_phrases(docs, bench).orderBy("doc_id").collect()][1:] == ["", "nothing here"]
