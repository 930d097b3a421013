"""Quality of a text without labels: heuristic labellers, weighed by EM, train a hashed linear scorer.

Method: each labeller votes good, bad or abstains. Under one hidden class a text, with votes independent given the
class, expectation-maximisation estimates each labeller's votes by class and the classes' share. It runs on the counts
of vote patterns over all texts (at most 2^9 * 3^3). Posterior labels of a bounded sample of texts
train a logistic scorer on hashed features: shapes of words, pairs of shapes, repeats of the word before and line
starts. The scorer judges all texts.

Defined results: null and empty texts count as having no words (the length labeller votes bad) and are scored so;
texts of any length are scored whole; repeated rows each give their row; if all texts have one pattern all get its
posterior's class; an empty table gives an empty table; extra columns are carried along, those named like outputs replaced.

The sample: SAMPLE texts of the smallest key hashes with SAMPLE_CHARS characters or fewer.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import arrow_map, chunks
from tessera.llm.html import STOP_WORDS

SAMPLE, SAMPLE_CHARS = 6000, 20_000
BUCKETS = 4096
KEEP = 0.5
#: The text's name beside columns that are carried along.
TEXT, KEY = "__tessera_text", "__tessera_key"
CACHE_WORDS = 200_000
_ODD = b"#%$&*|<>{}\\=_~^@+[]/"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_STRIP = ".,;:!?\"'()«»…%$#&*|"


class Voter:
    """One sign a labeller: nine look for a defect (bad or abstain), three judge either way."""

    STOP, CLOSED, CAPS, LOUD, EMPTY = 1, 2, 4, 8, 16

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.plain: dict[str, int] = {}

    def _code(self, word: str) -> int:
        """A number for the bare lower-case word, times 32, and what the word shows."""
        low = word.strip(_STRIP).lower()
        shows = (self.STOP * (low in STOP_WORDS)) | (self.CLOSED * (len(word) > 1 and word[-1] == word[-2] and not word[-1].isalnum()))
        shows |= (self.CAPS * (len(word) > 1 and word.isupper())) | (self.LOUD * word.endswith("!")) | (self.EMPTY * (low == ""))
        return self.plain.setdefault(low, len(self.plain)) * 32 + shows

    def __call__(self, text: str | None) -> str:
        text = text or ""
        words, raw = text.split(), text.encode()
        n, size = len(words), max(1, len(raw))
        known = self.codes
        if len(known) > CACHE_WORDS:
            known.clear()
            self.plain.clear()
        for w in words:
            if w not in known:
                known[w] = self._code(w)
        code = np.fromiter(map(known.__getitem__, words), np.int64, n)
        plain, shows = code >> 5, code & 31
        share = lambda flag: np.count_nonzero(shows & flag) / max(1, n)
        gone = lambda signs: len(raw) - len(raw.translate(None, signs))
        lines = [x for x in map(str.strip, text.split("\n")) if x]
        stops, ended = share(self.STOP), sum(x[-1] in ".!?…" for x in lines) / max(1, len(lines))
        defects = (
            gone(_ODD) > 0.02 * size,
            share(self.CLOSED) > 0.2,
            gone(_UPPER) > 0.3 * max(1, gone(_LETTERS)),
            share(self.CAPS) > 0.5,
            share(self.LOUD) > 0.2,
            np.count_nonzero((plain[1:] == plain[:-1]) & (shows[1:] & self.EMPTY == 0)) > 0.1 * max(1, n),
            n >= 30 and len(zlib.compress(raw, 1)) < 0.2 * size,
            len(np.unique(plain)) < 0.35 * min(1.0, 14 / math.sqrt(max(1, n))) * n,
            share(self.EMPTY) > 0.2,
        )
        either = ((n < 6, n >= 30), (stops < 0.04 and n >= 6, stops > 0.12), (ended < 0.2, ended > 0.6))
        return "".join(["-" if x else "0" for x in defects] + ["-" if bad else "+" if good else "0" for bad, good in either])


def weigh(patterns: list[tuple[str, int]], rounds: int = 100) -> dict[str, float]:
    """The posterior of good for each pattern, by EM from the majority's vote."""
    if not patterns:
        return {}
    patterns = sorted(patterns)
    code = np.array([["-0+".index(c) for c in p] for p, _ in patterns])
    count = np.array([c for _, c in patterns], float)
    lean = (code - 1) @ np.array([2.0] * 9 + [1.0] * (code.shape[1] - 9))
    good = 1 / (1 + np.exp(-(lean + 0.5)))
    for _ in range(rounds):
        share = (count * good).sum() / count.sum()
        share = min(max(share, 0.01), 0.99)
        log = [np.log(1 - share) * np.ones(len(code)), np.log(share) * np.ones(len(code))]
        for y, w in ((0, count * (1 - good)), (1, count * good)):
            for j in range(code.shape[1]):
                p = np.bincount(code[:, j], w, 3) + np.array([1.5, 1.0, 0.5] if y == 0 else [0.5, 1.0, 1.5])  # a vote is likelier right
                log[y] += np.log(p / p.sum())[code[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done = np.abs(new - good).max() < 1e-6
        good = new
        if done:
            break
    return dict(zip((p for p, _ in patterns), good.tolist(), strict=True))


def shape(word: str) -> int:
    """A checksum of a word's kinds of signs, runs shortened, with whether it is a stop word."""
    out = []
    for c in word[:64]:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if ord(c) < 128 else "?"
        if not (len(out) > 1 and out[-1] == out[-2] == k):
            out.append(k)
    size = "s" if len(word) < 4 else "m" if len(word) < 12 else "l"
    return zlib.crc32(("".join(out) + size + ("!" if word.strip(_STRIP).lower() in STOP_WORDS else "")).encode())


class Hashed:
    """Square roots of the shares of hashed features."""

    def __init__(self):
        self.shapes: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").replace("\n", " \n ").split(" ")
        words = [w for w in words if w]
        if not words:
            out = np.zeros(BUCKETS, np.float32)
            out[0] = 1
            return out
        if len(self.shapes) > CACHE_WORDS:
            self.shapes.clear()
        known = self.shapes
        for w in words:
            if w not in known:
                known[w] = shape(w)
        s = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        code = np.fromiter(map(hash, words), np.int64, len(words))
        again = np.flatnonzero(code[1:] == code[:-1])
        ids = np.concatenate((s % (BUCKETS // 2 - 8) + 8, (s[1:] * 31 + s[:-1]) % (BUCKETS // 2) + BUCKETS // 2, np.full(len(again), 1), np.full(1, 2 + min(5, int(math.log10(len(words) + 1))))))
        return np.sqrt(np.bincount(ids, minlength=BUCKETS) / len(words)).astype(np.float32)


def fit(texts: list[tuple[str | None, float]], steps: int = 300) -> np.ndarray:
    """Weights and last the bias, from (text, posterior)."""
    w = np.zeros(BUCKETS + 1)
    if not texts:
        return w
    cut = Hashed()
    x = np.stack([np.append(cut(t), 1) for t, _ in texts]).astype(np.float32)
    y = np.array([p for _, p in texts], np.float32)
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum())).astype(np.float32)
    v, old = w.astype(np.float32), w.astype(np.float32)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - 4.0 * ((weight * (p - y)) @ x + 1e-5 * v)
        v, old = new + t / (t + 3) * (new - old), new
    return old.astype(np.float64)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``quality`` (0 to 1) added."""
    spark, base = docs.sparkSession, docs.drop("quality")

    def label(batches):
        vote = Voter()
        for b in chunks(batches, TEXT, 8 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([vote(t) for t in b.column(TEXT).to_pylist()])], ["pattern"])

    found = arrow_map(base.select(F.col(text).alias(TEXT)), label, "pattern string").groupBy("pattern").count()
    belief = weigh([(r[0], r[1]) for r in found.collect()])
    short = base.where(F.coalesce(F.length(text), F.lit(0)) <= SAMPLE_CHARS).select(F.col(key).alias(KEY), F.xxhash64(key).alias("h"))
    picked = short.orderBy("h").limit(SAMPLE).select(KEY).distinct()  # keys only: texts come over for the picked rows alone
    rows = base.select(F.col(key).alias(KEY), F.col(text).alias(TEXT)).join(F.broadcast(picked), KEY, "left_semi").where(F.coalesce(F.length(TEXT), F.lit(0)) <= SAMPLE_CHARS)
    texts, vote = [r[0] for r in rows.select(TEXT).limit(2 * SAMPLE).collect()], Voter()
    texts.sort(key=lambda t: t or "")
    weights = fit([(t, belief.get(vote(t), 0.5)) for t in texts])
    shared, names = spark.sparkContext.broadcast(weights.astype(np.float32)), base.columns
    schema = StructType([*base.schema.fields, StructField("quality", DoubleType())])

    def run(batches):
        cut, w = Hashed(), shared.value
        for b in chunks(batches, TEXT, 8 << 20):
            texts = b.column(TEXT).to_pylist()
            out = [float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(cut(t) @ w[:-1] + w[-1])))))) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.float64())], [*names, "quality"])

    return arrow_map(base.withColumn(TEXT, F.col(text)), run, schema)
