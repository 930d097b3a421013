"""The methods themselves, without Spark: each against a brute-force version, a public library or planted cases."""

import json
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import bpe, fmindex, html, jaccard, lm, maxscore, quality, substrings, toxicity, urls
from tessera.llm.common import alnum_words, space_words

# BPE


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    from tessera.llm.queries import vocabulary

    return bpe.WordBpe(json.load(open(vocabulary()))), Tokenizer.from_file(vocabulary())


ODD = ["", " ", "ΑΣ ΟΔΟΣ", "İstanbul <|startoftext|>x<|endoftext|>", "a\x1cb\x85c​d 日本語 é 'S don't I'LL", "<|startoftext|", "123 ½ ²", "ａｂｃ", "\x00\x01 ﻿", "x" * 3000, "🙂🙂 👩‍👩‍👧", "é", "᠎ 　", "ﬁ ǅ ẞ"]


@pytest.mark.parametrize("text", ODD)
def test_bpe_as_the_library(both, text):
    ours, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_random_unicode(both):
    ours, theirs = both
    rng = random.Random(5)
    pools = ["abcdefgh ", "aéèüñç .,'", "αβΣσς ", "0123456789½² ", "!?%&<>| \n\t", "日本語漢字 ", "🙂👍 a"]
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60)))
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids, text


def test_runs_met_again_are_not_split_again(both):
    """Only new runs without white space are cut into pieces and merged; separators that Unicode does not count as white space stay."""
    ours, theirs = both
    for text in ("It's 12 o'clock, isn't it?", "a\x1cb \x1f c\x85d", "<|endoftext|>x <y> 漢字，Σσ"):
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    split, ours.split = ours.split, None
    try:
        assert ours.encode("isn't it? It's 12") == theirs.encode("isn't it? It's 12", add_special_tokens=False).ids
    finally:
        ours.split = split


def test_bpe_with_a_small_cache(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    ours, theirs = bpe.WordBpe(json.load(open(__import__("tessera.llm.queries", fromlist=["x"]).vocabulary()))), both[1]
    rng = random.Random(6)
    words = ["river", "light", "houses", "walking", "zwackel", "été"]
    for _ in range(50):
        text = " ".join(rng.choices(words, k=20))
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids
        assert len(ours.cache) <= 3 and len(ours.old) <= 3


# FM-index


def brute_phrases(words, items, window):
    hit, found = set(), set()
    for item, text in items:
        w = alnum_words(text)
        for p in [w[k : k + window] for k in range(max(1, len(w) - window + 1))] if w else []:
            for at in range(len(words) - len(p) + 1):
                if words[at : at + len(p)] == p:
                    hit.update(range(at, at + len(p)))
                    found.add(item)
    return sorted(hit), found


def test_fm_index_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        letters = [bytes([97 + k]) for k in range(rng.randint(1, 4))]
        docs = [[rng.choice([*letters, b"zz"]) for _ in range(rng.randint(0, 60))] for _ in range(6)]
        items = [(i, b" ".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))) for i in range(5)]
        window = rng.choice([3, 10])
        phrases = fmindex.Phrases(items, window)
        for words, (hit, found) in zip(docs, fmindex.search_shard(docs, phrases), strict=True):
            assert (hit.tolist(), found) == brute_phrases(words, items, window)


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    column = rng.integers(0, 13, 200)
    m = fmindex.WaveletMatrix(column, 12)
    for s in range(13):
        assert [int(x) for x in m.rank(np.full(201, s), np.arange(201))] == [int((column[:k] == s).sum()) for k in range(201)]
    symbols, before = m.access(np.arange(200))
    assert symbols.tolist() == column.tolist() and before.tolist() == [int((column[:k] == column[k]).sum()) for k in range(200)]


def test_cut_words():
    assert fmindex.cut_words("One two, three. Four", [{"start": 1, "end": 3}]) == "One Four"
    assert fmindex.cut_words(None, None) is None and fmindex.cut_words("a b", []) == "a b" and fmindex.cut_words("é è", [{"start": 0, "end": 2}]) == ""


# Jaccard


def brute_set(text):
    w = space_words(text)
    if not w:
        return set()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_shingles_follow_the_words():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", ".", "ab "]) for _ in range(rng.randint(0, 80))).encode()
        assert len(jaccard.word_hashes(text)) == len(space_words(text))
        assert len(jaccard.shingle_set(text)) == len(brute_set(text))


def test_word_hashes_do_not_depend_on_the_place(monkeypatch):
    a, b = b"alpha beta gamma", b"xx   beta\n"
    assert jaccard.word_hashes(a)[1] == jaccard.word_hashes(b)[1]
    whole = jaccard.word_hashes(b"one two three four five " * 50)
    monkeypatch.setattr(jaccard, "SEGMENT", 37)
    assert np.array_equal(whole, jaccard.word_hashes(b"one two three four five " * 50))
    assert len(jaccard.word_hashes(b"x" * 200 + b" y")) == 2


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 300, 900])
def test_rtree_finds_all_that_the_bound_leaves(n):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 4, (6, jaccard.GROUPS)).astype(np.uint8)
    points = np.array([np.maximum(0, base[i % 6].astype(int) + rng.integers(-1, 2, jaccard.GROUPS) * (rng.random(jaccard.GROUPS) < 0.15)) for i in range(n)]).astype(np.uint8)
    size, group, cell = points.sum(1).astype(np.int64), rng.integers(0, 40, n), np.sort(rng.integers(0, max(1, n // 50), n))
    order = np.lexsort((size, cell))
    points, size, group, cell = points[order], size[order], group[order], cell[order]
    got = {(a, b) for p, q in jaccard.RTree(cell, size, group, points).pairs() for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    want = set()
    for a in range(n):
        low = np.minimum(points, points[a]).sum(1, dtype=np.int64)
        good = (7 * low >= 3 * (size + size[a])) & (4 * np.minimum(size, size[a]) >= 3 * np.maximum(size, size[a])) & (group != group[a]) & (cell == cell[a])
        want |= {(a, int(b)) for b in np.flatnonzero(good) if b > a}
    assert got == want


def cell_batches(rows, names, arrays, size):
    import pyarrow as pa

    for a in range(0, len(rows), size):
        some = list(zip(*rows[a : a + size], strict=True))
        kinds = [pa.int64()] * (len(names) - arrays) + [pa.binary(), pa.list_(pa.int64())][:arrays]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(some, kinds, strict=True)], names)


@pytest.mark.parametrize("batch", [7, 64, 5000])
def test_all_candidates_of_the_documents_come_from_trees(batch, monkeypatch):
    """The cells of a whole small table: trees are built whatever a cell's size, and leave no linked pair out."""
    import pandas as pd

    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    built = []
    init = jaccard.RTree.__init__
    monkeypatch.setattr(jaccard.RTree, "__init__", lambda self, *a: (built.append(len(a[0])), init(self, *a))[1])
    sets = {int(i): jaccard.shingle_set((t or "").encode()) for i, t in zip(d.doc_id, d.text, strict=True)}
    cells = {}
    for i, s in sets.items():
        for x in s[: len(s) // 4 + 1]:
            cells.setdefault(int(x), []).append(i)
    cells = {s: ids for s, ids in cells.items() if len(ids) > 1}
    rows = sorted((s, 0, 0, len(sets[i]), i, i, 3, jaccard._counts(sets[i]), [s] * jaccard.FIRST) for s, ids in cells.items() for i in ids)
    found = set()
    for b in jaccard._second_step(cell_batches(rows, ["s", "i", "j", "n", "id", "component", "role", "point", "first"], 2, batch)):
        found |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True))
    assert built and sum(built) == len(rows)
    linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    pairs = {(a, b) for ids in cells.values() for a in ids for b in ids if a < b}
    assert {p for p in pairs if linked(*p)} <= found <= pairs
    rows = sorted((r[0], 0, r[3], r[4], r[7]) for r in rows)
    first = set()
    for b in jaccard._first_step(cell_batches(rows, ["s", "block", "n", "id", "point"], 1, batch)):
        first |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True))
    assert first <= found and first


def test_bound_never_undercuts():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ({rng.randrange(500) for _ in range(rng.randint(1, 300))} for _ in range(2))
        x, y = (np.frombuffer(jaccard._counts(np.array(sorted(s), np.int64)), np.uint8) for s in (a, b))
        assert np.minimum(x, y).sum(dtype=int) >= len(a & b)


# MaxScore


def test_maxscore_against_brute_force():
    rng = np.random.default_rng(6)
    for trial in range(30):
        n, d, k = int(rng.integers(1, 400)), int(rng.integers(1, 12)), 10
        rows = rng.integers(-6, 7, (n, d)) if trial % 2 else (rng.normal(size=(n, d)) * 900).astype(np.int64)
        ids = rng.permutation(n).astype(np.int64)
        for q in range(min(n, 5)):
            best = maxscore.Best(k)
            for at in range(0, n, 64):
                c = np.ascontiguousarray(rows[at : at + 64].T.astype(float))
                maxscore.search_shard(ids[at : at + 64], c, c.min(1), c.max(1), rows[q].astype(float), int(ids[q]), best)
            s = rows @ rows[q]
            want = sorted(((-int(s[i]), int(ids[i])) for i in range(n) if ids[i] != ids[q]))[:k]
            assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == want


# Substrings


def test_units_cover_the_text():
    rng = random.Random(7)
    for _ in range(100):
        text = "".join(rng.choice(["ab ", "Cd ", "e. ", "\n", "!? ", "x", "É ", "long" * 5 + " "]) for _ in range(rng.randint(0, 300)))
        found = substrings.units(text)
        assert all(a[0] < b[0] for a, b in zip(found, found[1:], strict=False))
        assert [w for u in found for w in u[1].split()] == alnum_words(text.encode())


def test_removal_needs_a_run_of_words():
    text = "Alpha beta gamma delta. Epsilon zeta eta theta iota. Kappa lambda mu nu xi. End of it all now."
    assert substrings.removal(text, [0]) == []
    assert substrings.removal(text, [0, 1, 2]) == [(0, text.index("End"))]


def removed_copies(texts):
    """The share of words removed from each text, after those before it."""
    seen, shares = set(), []
    for text in texts:
        found = substrings.units(text)
        cut = substrings.removal(text, [i for i, u in enumerate(found) if u[2] >= substrings.TINY and u[1] in seen])
        shares.append(sum(b - a for a, b in cut) / len(text))
        seen |= {u[1] for u in found}
    return shares


def test_repeats_of_short_units():
    rng = random.Random(3)
    shout, names = "WORD!! " * 160, "\n".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80)) + "\n"
    more = "\n".join("".join(rng.choices("ijklmnop", k=6)) for _ in range(30)) + "\n"
    chinese = "这是一个没有空格的句子而且它很长很长。第二个句子也在这里等着被人发现！" * 2
    for text in (shout, names, chinese, chinese.replace("。", "").replace("！", "") + "\n"):
        assert removed_copies([text, text])[1] == 1
        assert removed_copies([text, "Here is some fresh text of its own.\n" + text])[1] > 0.9 * len(text) / (len(text) + 36)
    assert removed_copies([names, more + names + more])[1] > 0.8 * len(names) / len(more + names + more)
    assert removed_copies([names, more]) == [0, 0]


# HTML

ARTICLE = "The quick brown fox is in the garden and it was looking for the dog that had been with us for so long, but the dog was not there and so the fox went on to the other side of the river where it had been before, and slept."
PAGE = f"""<html><head><title>T</title><style>p{{x}}</style></head><body class="has-sidebar"><header><h1>Site</h1><p>{ARTICLE}</p></header><div id="nav-main"><a href=x>Home</a></div>
<div class="content"><h2>Title here</h2><p>{ARTICLE}</p><p>Short&nbsp;one  &amp; <b>bold</b>.</p><div class="ad-box">{ARTICLE}</div><ul><li>The list item</li></ul><p>{ARTICLE}</p>
<form><p>{ARTICLE}</p></form><div class="comments"><p>{ARTICLE}</p></div></div><aside>{ARTICLE}</aside><div class="cookie-notice">{ARTICLE}</div><script>var x = "<p>no</p>";</script><footer>{ARTICLE}</footer></body></html>"""


def test_main_text_without_an_article_element():
    assert html.main_text(PAGE) == "\n".join(("Title here", ARTICLE, "Short one & bold.", "The list item", ARTICLE))


def test_main_text_inside_an_article_element():
    page = f'<body><p>{ARTICLE}</p><article class="post"><h1>Head</h1><p>A. B<br>c</p><p><b>x<br><p>y</p><div class="share">Share</div></article><article class="comment"><p>{ARTICLE}</p></article></body>'
    assert html.main_text(page) == "Head\nA. B c\nx\ny"


@pytest.mark.parametrize("page", [None, "", "<", "<a \"", "<!-- x", "<script>never closed", "<div>" * 3000, "<p>\x00</p>", "&#xD800;&bogus;", "<" * 5000])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html.main_text(page), str)


# Toxicity, quality, language model


def test_toxic_words_with_gaps_and_endings():
    rng = random.Random(9)
    parts = "an er th on re in en at ou ti is es".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    texts = []
    for k in range(500):
        w = [word() for _ in range(rng.randint(5, 60))]
        if k % 5 == 0:
            for insult in rng.sample(["grumpf", "zwackel", "blorko"], 2):
                w.insert(rng.randrange(len(w)), insult + rng.choice(["", "s", "an"]))
        texts.append((" ".join(w), int(k % 5 == 0)))
    model = toxicity.fit(texts[:400])
    score = lambda t: model.probability(*toxicity._top_two(model.margins(toxicity.words_of(t))))
    held = [(score(t) >= toxicity.THRESHOLD, bool(y)) for t, y in texts[400:]]
    assert sum(p == y for p, y in held) >= 97
    assert score("on the grum-pf and zwack.el") > score("on the ther and ourestion")
    assert score("then b l o r k o ation z w a c k e l en") > 0.5
    assert score("") <= min(score(t) for t, y in texts if y)
    assert toxicity.fit([]).probability(1, 1) < 1e-9 and toxicity.fit([("a", 1)]).probability(1, 1) < 1e-9


def plain_subsequences(word):
    """By definition: every three symbols in order within a span, DECAY to the power of the span, over the root of the sum of squares."""
    c = toxicity.symbols(word)
    found = [(c[i], c[j], c[k], toxicity.DECAY ** (k - i + 1)) for i in range(len(c)) for j in range(i + 1, len(c)) for k in range(j + 1, len(c)) if k - i < toxicity.SPAN]
    norm = math.sqrt(sum(w * w for *_, w in found)) or 1.0
    out = {}
    for a, b, d, w in found:
        out[a, b, d] = out.get((a, b, d), 0.0) + w / norm
    return out


def test_toxicity_training_makes_no_whole_copies():
    """The driver trains beside its JVM: the folded table is 38 MB, and a copy of it in doubles was 76 more."""
    import tracemalloc

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    bad, good = [word(6) for _ in range(200)], [word(5) for _ in range(1500)]
    texts = [(" ".join([*rng.sample(good, 8), *rng.sample(bad, 2 * (i % 2))]), i % 2) for i in range(300)]
    tracemalloc.start()
    toxicity.fit(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6


def test_string_kernel_by_definition():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd-é1") for _ in range(rng.randint(2, 14))) for _ in range(30)]
    folded = np.zeros((toxicity.SYMBOLS**3, len(words)), np.float32)
    for rows, ids, w in toxicity.features(words):
        for r, row in zip(rows, ids, strict=True):
            np.add.at(folded[:, r], row, w)
    got = toxicity._kernel(words, folded)
    for i, a in enumerate(words):
        x = plain_subsequences(a)
        for j, b in enumerate(words):
            y = plain_subsequences(b)
            assert math.isclose(got[i, j], sum(v * y.get(k, 0.0) for k, v in x.items()), rel_tol=1e-4, abs_tol=1e-6)


def test_long_words_score_as_short_ones_do():
    rng = np.random.default_rng(6)
    table = rng.normal(size=toxicity.SYMBOLS**3).astype(np.float32)
    letters = "abcxyz-éß9漢"
    for n in (2, 3, 5, 40, 61, 62, 63, 64, 200):
        word = "".join(letters[i] for i in rng.integers(0, len(letters), n))
        want = sum(v * table[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] for (a, b, c), v in plain_subsequences(word).items())
        assert math.isclose(toxicity.long_margin(table, word), want, rel_tol=1e-4, abs_tol=1e-4)
        assert math.isclose(float(toxicity.Model(table, 0.0, (1, 0, 0)).margins([word])[0]), want, rel_tol=1e-3, abs_tol=1e-3)


def test_a_token_of_two_megabytes_needs_little_memory():
    import tracemalloc

    model = toxicity.Model(np.ones(toxicity.SYMBOLS**3, np.float32), 0.0, (1, 0, 0))
    text = "漢x-" * 700_000
    tracemalloc.start()
    (word,) = toxicity.words_of(text)
    assert math.isfinite(float(model.margins([word])[0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20


def test_weak_labels_find_junk():
    rng = random.Random(2)
    fine = [" ".join(rng.choice("the of and with house river green walks over".split()) for _ in range(60)).capitalize() + "." for _ in range(300)]
    junk = [" ".join(rng.choice(["buy%%%", "now***", "A$$$"]) for _ in range(60)) for _ in range(40)] + [("SPAM!! OFFER!! " * 40) for _ in range(10)]
    from collections import Counter

    vote = quality.Voter()
    belief = quality.weigh(list(Counter(map(vote, fine + junk)).items()))
    assert min(belief[vote(t)] for t in fine) > 0.5 > max(belief[vote(t)] for t in junk)
    w = quality.fit([(t, belief[vote(t)]) for t in fine + junk])
    score = lambda t: float(quality.Hashed()(t) @ w[:-1] + w[-1])
    assert min(map(score, fine)) > max(map(score, junk))
    assert isinstance(vote(None), str) and vote(None) == vote("")


def plain_em(patterns, rounds=100):
    """The same model by loops over votes: shares of votes by class with the stated prior counts, posteriors by Bayes."""
    lean = lambda p: sum(("-0+".index(c) - 1) * (2.0 if j < 9 else 1.0) for j, c in enumerate(p))
    good = {p: 1 / (1 + math.exp(-(lean(p) + 0.5))) for p, _ in patterns}
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        share = min(max(sum(n * good[p] for p, n in patterns) / total, 0.01), 0.99)
        new = {}
        chance = {}
        for y in (0, 1):
            for j in range(len(patterns[0][0])):
                votes = {c: prior for c, prior in zip("-0+", (1.5, 1.0, 0.5) if y == 0 else (0.5, 1.0, 1.5), strict=True)}
                for p, n in patterns:
                    votes[p[j]] += n * (good[p] if y else 1 - good[p])
                for c in "-0+":
                    chance[y, j, c] = votes[c] / sum(votes.values())
        for p, _ in patterns:
            bad = math.log(1 - share) + sum(math.log(chance[0, j, c]) for j, c in enumerate(p))
            fine = math.log(share) + sum(math.log(chance[1, j, c]) for j, c in enumerate(p))
            new[p] = 1 / (1 + math.exp(max(-50, min(50, bad - fine))))
        done = max(abs(new[p] - good[p]) for p in new) < 1e-6
        good = new
        if done:
            break
    return good


def test_em_by_plain_loops():
    rng = random.Random(15)
    patterns = {}
    for _ in range(300):
        bad = rng.random() < 0.3
        p = "".join("-" if rng.random() < (0.4 if bad else 0.03) else "0" for _ in range(9)) + "".join(rng.choice("--0" if bad else "0++") for _ in range(3))
        patterns[p] = patterns.get(p, 0) + rng.randint(1, 5)
    got, want = quality.weigh(list(patterns.items())), plain_em(sorted(patterns.items()))
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-5 for p in want)


def test_hashed_features_by_counting():
    rng = random.Random(16)
    for _ in range(40):
        text = " ".join(rng.choice(["The", "river", "42", "A$$$", "house,", "river", "\n"]) for _ in range(rng.randint(1, 50)))
        words = [w for w in text.replace("\n", " \n ").split(" ") if w]
        counts = {}
        add = lambda i: counts.__setitem__(i, counts.get(i, 0) + 1)  # noqa: B023,E731
        s = [quality.shape(w) for w in words]
        for k, x in enumerate(s):
            add(x % (quality.BUCKETS // 2 - 8) + 8)
            if k:
                add((x * 31 + s[k - 1]) % (quality.BUCKETS // 2) + quality.BUCKETS // 2)
                if words[k] == words[k - 1]:
                    add(1)
        add(2 + min(5, int(math.log10(len(words) + 1))))
        got = quality.Hashed()(text)
        assert set(np.flatnonzero(got).tolist()) == set(counts) and all(math.isclose(got[i], math.sqrt(n / len(words)), rel_tol=1e-5) for i, n in counts.items())


def test_best_class_by_the_whole_likelihood():
    """The class chosen is the one with the highest likelihood of the table that results, counted anew for each choice."""
    rng = np.random.default_rng(5)
    n, k = 30, 5  # unit n is the end
    pairs = rng.integers(0, 6, (n + 1, n + 1)) * (rng.random((n + 1, n + 1)) < 0.5)
    group = np.append(rng.integers(0, k - 1, n), k - 1)

    def table(group):
        one = np.eye(k)[group]
        return one.T @ pairs @ one

    x_log_x = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    likelihood = lambda t: x_log_x(t) - x_log_x(t.sum(0)) - x_log_x(t.sum(1))
    one = np.eye(k)[group]
    right, left, own = pairs @ one, pairs.T @ one, np.diagonal(pairs)
    got = lm.best_classes(table(group), group[:n], right[:n], left[:n], own[:n])
    for u in range(n):
        tries = [likelihood(table(np.where(np.arange(n + 1) == u, c, group))) for c in range(k - 1)]
        assert tries[got[u]] >= max(tries) - 0.02, u


def test_exchange_separates_two_languages():
    rng = np.random.default_rng(0)
    pairs = np.zeros((41, 41))
    for a in range(40):
        for b in range(40):
            if a % 2 == b % 2:
                pairs[a, b] = rng.integers(5, 20)
    pairs[40, :40] = pairs[:40, 40] = 3
    group = lm.exchange(pairs, classes=2, sweeps=20)
    assert group[40] == 2 and len(set(group[0:40:2])) == 1 and len(set(group[1:40:2])) == 1 and group[0] != group[1]


def generated_page(rng, marked, frame):
    """A page from known parts: (markup, main text). Prose has stop words, boilerplate is links, short notes or forms."""
    stop, rare = "the of and to in that it with for was on as by from".split(), "river stone light house garden window letter morning winter market".split()
    prose = lambda n: " ".join(rng.choice(stop if rng.random() < 0.45 else rare) for _ in range(n)).capitalize() + "."
    parts = [("h1", " ".join(rng.sample(rare, 4)))] + [("p", prose(rng.choice([3, 25, 60, 90]))) for _ in range(rng.randint(4, 9))]
    parts[1] = ("p", prose(70))
    parts[-1] = ("p", prose(80))
    body = "".join(f"<{t}>{x}</{t}>" for t, x in parts)
    menu = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(rare, 6)) + "</ul>"
    links = "<div>" + " ".join(f'<a href="/{w}">{w} and the {w}</a>' for w in rng.sample(rare, 5)) + "</div>"
    page = f"<nav>{menu}</nav>{links}" + (f"<article>{body}</article>" if marked else f"<div>{body}</div>")
    page += f'<form action="/login"><label>Name</label><p>{prose(20)}</p></form><div class="comments"><p>{prose(60)}</p></div><footer>&copy; 2020 {prose(5)}</footer>'
    page = {"form": f'<form id="aspnet">{page}</form>', "search": f'<div class="search-results">{page}</div>', "": page}[frame]
    return f"<html><head><title>x</title></head><body>{page}</body></html>", "\n".join(x for _, x in parts)


@pytest.mark.parametrize("frame", ["", "form", "search"])
@pytest.mark.parametrize("marked", [True, False])
def test_main_text_of_generated_pages(marked, frame):
    rng = random.Random(41)
    for _ in range(60):
        page, want = generated_page(rng, marked, frame)
        assert html.main_text(page) == want


def test_both_passes_decide():
    """On a page without a marked article labels come from density, links and neighbours alone."""
    rng = random.Random(42)
    page, want = generated_page(rng, False, "")
    found = html.blocks(page)
    labels, believed = html._first_pass(found)
    kept = html._second_pass(found, labels, believed)
    assert not believed and {"good", "near", "short", "heading", "bad"} >= set(labels)
    assert "good" in labels and any(x == "bad" and not b.bad for x, b in zip(labels, found, strict=True))
    assert any(k and x in ("near", "short") for k, x in zip(kept, labels, strict=True))


def test_a_teaser_article_does_not_hide_the_story():
    rng = random.Random(43)
    story = [" ".join(rng.choice("the of and house river with light was it on".split()) for _ in range(60)).capitalize() + "." for _ in range(4)]
    page = "<article>Teaser</article><div>" + "".join(f"<p>{x}</p>" for x in story) + "</div>"
    assert html.main_text(page).endswith("\n".join(story))
    assert html.main_text("<article><h1>A title</h1><p>Short text.</p><p>Ends &copy; here.</p></article><footer>foot</footer>") == "A title\nShort text.\nEnds © here."
    assert html.main_text("<p>Only this.</p>") == "Only this."
    assert html.main_text("<nav><a>x</a></nav><div class='ad'>Buy it of the and now</div>") == ""
