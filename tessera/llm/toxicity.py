"""Toxicity of a text by a subsequence string-kernel SVM with Nyström landmarks.

Method: the kernel of two words counts common subsequences of three symbols (letters, other signs, both word ends),
each weighted by DECAY to the power of the span it takes in either word, over spans up to SPAN, divided by a factor
of each word's length. So an insult with inserted letters, gaps or a new ending stays close to its plain form. Words
of labelled texts are mapped to the kernel's values at LANDMARKS words, whitened (Nyström), and a linear SVM is
trained on them; which words of a toxic text are the toxic ones is found by alternating: train, choose each toxic
text's highest words, train again. Since the kernel is a sum over subsequences, the SVM folds into one table of
subsequence weights. A text's score is a logistic function of its two highest words' margins.

Words of over LONG symbols are scored piece by piece, in memory that does not grow with them; only shorter ones are
trained on and remembered. Runs of three or more single signs between blanks (``i d i o t``) count as one word, too.

Defined results: null and empty texts have no words and get the lowest score; texts of any length are scored whole;
equal texts get equal scores; a null key is not held out; repeated rows each give their row; without labelled rows of both classes every score is
0; an empty table gives an empty table; other columns never enter a score.

Training takes at most TRAIN_TOXIC and TRAIN_CLEAN labelled texts (those of the smallest key hashes) of at most
TRAIN_CHARS characters: the documented bound of the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import arrow_map, chunks, fold_bucket, give_back
from tessera.storage import broadcast_if_small

TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 2000, 4000, 20_000
LANDMARKS, NEGATIVES, DECAY, SPAN = 160, 12_000, 0.6, 7
ROUNDS = 5
THRESHOLD = 0.7
CACHE_WORDS = 60_000
#: Symbols of a word whose subsequences are listed at once; longer words are taken in pieces of PIECE symbols.
LONG, PIECE = 64, 1 << 16
#: Rows of a matrix of training that are worked on at once, so that no whole copy of it is made.
PART = 2048
LOWEST = -3.0
#: The text's name beside columns that are carried along.
TEXT = "__tessera_text"

OTHER, MARK, OPEN, CLOSE = 26, 36, 37, 38
SYMBOLS = 39
# Signs commonly put for letters.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
_SINGLES = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def symbols(word: str) -> list[int]:
    out = [OPEN]
    for c in word:
        if "a" <= c <= "z":
            out.append(ord(c) - 97)
        else:
            out.append(OTHER + ord(c) % 10 if c.isalpha() else MARK)
    out.append(CLOSE)
    return out


def plain(token: str) -> str:
    """A token without the punctuation around it, its look-alike signs read as letters."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum() and token[a] not in "@$":
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    word = token[a:b]
    return word if word.isalpha() else word.translate(LOOKALIKE) if any(map(str.isalpha, word)) else ""


_PLACES: dict[int, tuple[np.ndarray, ...]] = {}


def _places(n: int) -> tuple[np.ndarray, ...]:
    """All i < j < k < n with k - i < SPAN, and the weight of each."""
    if n not in _PLACES:
        ijk = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
        i, j, k = (np.array(x, np.int64) for x in zip(*ijk, strict=True)) if ijk else [np.empty(0, np.int64)] * 3
        w = DECAY ** (k - i + 1)
        _PLACES[n] = (i, j, k, (w / max(1e-9, np.sqrt((w * w).sum()))).astype(np.float32))
    return _PLACES[n]


def _codes(word: str) -> np.ndarray:
    """``symbols`` of a long word, a piece at a time."""
    out = [np.array([OPEN], np.uint8)]
    for a in range(0, len(word), PIECE):
        found, at = np.unique(np.frombuffer(word[a : a + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        out.append(np.array([symbols(chr(c))[1] for c in found.tolist()], np.uint8)[at])
    return np.concatenate((*out, np.array([CLOSE], np.uint8)))


def long_margin(table: np.ndarray, word: str) -> float:
    """What the listed subsequences of a word give, summed by the two steps between their symbols."""
    m, total, square = _codes(word), 0.0, 0.0
    for span in range(2, SPAN):
        starts, w = len(m) - span, DECAY ** (span + 1)
        square += max(0, starts) * (span - 1) * w * w
        for first in range(1, span):
            for a in range(0, starts, PIECE):
                i, j, k = (m[a + step : min(a + PIECE, starts) + step].astype(np.int32) for step in (0, first, span))
                total += w * float(table[(i * SYMBOLS + j) * SYMBOLS + k].sum(dtype=np.float64))
    return total / max(1e-9, square**0.5)


def features(words: list[str]):
    """For words grouped by length: their places in ``words``, subsequence numbers (word x place), weights (place)."""
    by: dict[int, list[int]] = {}
    coded = [symbols(w) for w in words]
    for at, c in enumerate(coded):
        by.setdefault(len(c), []).append(at)
    for n, rows in by.items():
        i, j, k, w = _places(n)
        for a in range(0, len(rows), max(1, 400_000 // max(1, len(i)))):
            some = rows[a : a + max(1, 400_000 // max(1, len(i)))]
            m = np.array([coded[r] for r in some], np.int64)
            yield np.array(some), (m[:, i] * SYMBOLS + m[:, j]) * SYMBOLS + m[:, k], w


@dataclass
class Model:
    table: np.ndarray
    bias: float
    weights: tuple[float, float, float]  # of the highest margin, of the second, constant

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.float32)
        short = [i for i, w in enumerate(words) if len(w) <= LONG - 2]
        for rows, ids, w in features([words[i] for i in short]):
            out[np.array(short)[rows]] = self.table[ids] @ w if len(w) else 0
        for i, w in enumerate(words):
            if len(w) > LONG - 2:
                out[i] = long_margin(self.table, w)
        return out + self.bias

    def probability(self, first: float, second: float) -> float:
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-np.clip(a * first + b * second + c, -30, 30))))


def tokens(text: str) -> set[str]:
    low = text.lower()
    found = set(low.split())
    for run in _SINGLES.findall(low):
        found.add("".join(run.split()))
    return found


def words_of(text: str) -> list[str]:
    return sorted({w for w in map(plain, tokens(text)) if len(w) > 1})


def _kernel(words: list[str], table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for rows, ids, w in features(words):
        for a in range(0, len(rows), 512):
            some = ids[a : a + 512]
            acc = np.zeros((len(some), table.shape[1]), np.float32)
            for p in range(some.shape[1]):
                acc += table[some[:, p]] * w[p]
            out[rows[a : a + 512]] = acc
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float, steps: int) -> np.ndarray:
    """Squared hinge with L2 decay by Nesterov's gradient descent; the last column of ``x`` is the bias."""
    scale = weight / weight.sum()
    square = sum((x[a : a + PART] * scale[a : a + PART, None]).T @ x[a : a + PART] for a in range(0, len(x), PART))
    top = float(np.linalg.eigvalsh(square)[-1]) * 2 + decay
    w = v = np.zeros(x.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * ((scale * y * slack) @ x) + decay * np.append(v[:-1], 0)
        new = v - grad / top
        w, v = new, new + t / (t + 3) * (new - w)
    return w


def fit(texts: list[tuple[str, int]], seed: int = 7) -> Model:
    """From (text, toxic) rows, in any order."""
    rng = np.random.default_rng(seed)
    texts = sorted(set(texts))
    if len({y for _, y in texts}) < 2:
        return Model(np.zeros(SYMBOLS**3, np.float32), LOWEST, (0.0, 0.0, -100.0))
    one: dict[str, str] = {}  # texts share their words
    bags = [([one.setdefault(w, w) for w in words_of(t) if len(w) <= LONG - 2], y) for t, y in texts]
    del one, texts
    order = rng.permutation(len(bags))
    part = len(bags) * 3 // 4
    learn, check = [bags[i] for i in order[:part]], [bags[i] for i in order[part:]]
    toxic, clean = Counter(), Counter()
    for words, y in learn:
        (toxic if y else clean).update(words)
    n_toxic, n_clean = sum(y for _, y in learn), sum(1 - y for _, y in learn)
    if not n_toxic or not n_clean:
        return Model(np.zeros(SYMBOLS**3, np.float32), LOWEST, (0.0, 0.0, -100.0))
    odds = {w: np.log((c + 0.05) / (n_toxic + 0.1)) - np.log((clean[w] + 0.05) / (n_clean + 0.1)) for w, c in toxic.items()}
    ranked = sorted((w for w in toxic if not clean[w]), key=lambda w: (-toxic[w], w))
    common = [w for w, _ in clean.most_common(LANDMARKS)]
    rare = sorted(clean)
    landmarks = sorted({*ranked[: LANDMARKS * 2 // 3], *common[: LANDMARKS // 6], *(rare[i] for i in rng.integers(0, len(rare), LANDMARKS // 6))})
    folded = np.zeros((SYMBOLS**3, len(landmarks)), np.float32)
    for rows, ids, w in features(landmarks):
        for r, row in zip(rows, ids, strict=True):
            np.add.at(folded[:, r], row, w)
    gram = _kernel(landmarks, folded).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > 1e-4 * value[-1]
    white = vector[:, keep] / np.sqrt(value[keep])
    listed = sorted({*toxic, *clean})
    at = {w: i for i, w in enumerate(listed)}
    negatives = np.unique(np.concatenate(([at[w] for w in common], rng.integers(0, len(rare), NEGATIVES))))
    negatives = np.array([at[rare[i % len(rare)]] for i in negatives])
    picked = Counter(w for words, y in learn if y for w in nlargest(2, words, key=lambda w: (odds[w], w)))
    model = Model(np.zeros(SYMBOLS**3, np.float32), 0.0, (1.0, 0.0, 0.0))
    for k in range(ROUNDS):
        chosen = [w for w in picked if clean[w] <= 0.02 * toxic[w] * n_clean / n_toxic]
        words = [*chosen, *(listed[i] for i in np.unique(negatives))]
        y = np.array([1.0] * len(chosen) + [-1.0] * (len(words) - len(chosen)))
        weight = np.array([float(min(picked[w], 20)) for w in chosen] + [1.0] * (len(words) - len(chosen)))
        weight[y > 0] *= (y < 0).sum() / max(1.0, weight[y > 0].sum()) * 0.5
        x = np.ones((len(words), white.shape[1] + 1))
        for a in range(0, len(words), PART):
            x[a : a + PART, :-1] = _kernel(words[a : a + PART], folded) @ white
        w = _svm(x, y, weight, 1e-4, 400)
        del x
        each = white @ w[:-1]
        model = Model(np.concatenate([folded[a : a + PART] @ each for a in range(0, len(folded), PART)]).astype(np.float32), float(w[-1]), (1.0, 0.0, 0.0))
        margin = model.margins(listed)
        if k < ROUNDS - 1:  # the hardest words of clean texts join the negatives; toxic texts choose anew
            among = np.array([at[w] for w in clean])
            negatives = np.concatenate((negatives, among[np.argsort(-margin[among])[:2000]]))
            picked = Counter()
            for bag, toxic_bag in learn:
                if toxic_bag and bag:
                    best = nlargest(3, bag, key=lambda w: (margin[at[w]], w))
                    picked.update(w for i, w in enumerate(best) if i == 0 or margin[at[w]] > 0)
    rows = [(*_top_two(model.margins(words)), y) for words, y in check]
    model.weights = _logistic(np.array(rows))
    return model


def _top_two(margins) -> tuple[float, float]:
    top = nlargest(2, map(float, margins))
    return (max(top[0], LOWEST) if top else LOWEST, max(top[1], LOWEST) if len(top) > 1 else LOWEST)


def _logistic(rows: np.ndarray) -> tuple[float, float, float]:
    x, y = np.c_[rows[:, :2], np.ones(len(rows))], rows[:, 2]
    w = np.zeros(3)
    for _ in range(60):  # Newton's steps, damped by a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w), -2, 2)
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on the labelled rows given; leave out those that must stay unseen."""
    docs = docs.select(F.col(key), F.col(text))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    fits = docs.where(F.length(text) <= TRAIN_CHARS).select(F.col(key).alias("_key"), F.xxhash64(key).alias("_order"))
    known = known.join(fits, "_key")
    picked = [known.where(f"_label = {y}").orderBy("_order", "_key").limit(n) for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    picked = picked[0].unionByName(picked[1])
    rows = docs.join(broadcast_if_small(picked, TRAIN_TOXIC + TRAIN_CLEAN), docs[key] == F.col("_key")).where(F.length(text) <= TRAIN_CHARS)
    model = fit([(r[0], int(r[1])) for r in rows.select(text, "_label").limit(2 * (TRAIN_TOXIC + TRAIN_CLEAN)).collect()])
    give_back()  # the driver lives on for other steps
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``toxicity`` added."""
    names = [c for c in (keep or docs.columns) if c != "toxicity"]
    schema = StructType([*(docs.schema[c] for c in names), StructField("toxicity", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, known = shared.value, {}
        for b in chunks(batches, TEXT, 1 << 20):
            bags = [tokens(t) if t else () for t in b.column(TEXT).to_pylist()]
            new = list({t for bag in bags for t in bag if t not in known})
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list({t for bag in bags for t in bag})
            words = list(map(plain, new))
            fit_for = [i for i, w in enumerate(words) if len(w) > 1]
            margin = np.full(len(new), LOWEST, np.float32)
            margin[fit_for] = model.margins([words[i] for i in fit_for])
            known.update(zip(new, margin.tolist(), strict=True))
            out = [model.probability(*_top_two(map(known.__getitem__, bag))) for bag in bags]
            for t in new:
                if len(t) > LONG:
                    del known[t]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.float64())], [*names, "toxicity"])

    return arrow_map(docs.select(*names, F.col(text).alias(TEXT)), run, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(fold_bucket(F.col(key), 3) == 1, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
