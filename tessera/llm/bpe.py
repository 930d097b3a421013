"""Byte-pair encoding and decoding with a public word-level vocabulary.

Method: the symbols of a word form a doubly linked list; a priority queue holds the ranks of the adjacent pairs
that can merge; the lowest (rank, position) merges first, and queue entries whose pair has changed since are stale
and skipped. Decoding concatenates vocabulary strings with the decoder's separator.

Defined results: null and empty texts give no ids and an empty decoded text; repeated rows each give their row;
texts of any length are encoded whole; an empty table gives an empty table; other columns are carried along, and a
column already named ``ids`` or ``decoded`` is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm.common import arrow_map, chunks, held

# Fixed values of the vocabulary's format: Unicode white space, and the pattern that splits normalised text.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+"

#: Words, and runs of them without white space, kept with their encoding, by a worker, in either of two generations: when
#: the younger is full it becomes the older, and what is met again moves back. What is forgotten costs time only.
CACHE_WORDS = 160_000
#: What ``str.split`` takes for white space and Unicode does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Bytes of text in one batch.
BATCH_BYTES = 1 << 20


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next letter from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Runs(dict):
    """Encoded runs by their text; one that is not held is encoded."""

    def __init__(self, encode: Callable[[str], tuple[bytes, str]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, run: str) -> tuple[bytes, str]:
        return self.encode(run)


class WordBpe:
    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.text = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: s for s, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.split = regex.compile(SPLIT)
        self.runs = regex.compile(rf"[^{WHITE_SPACE}]+")
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.single: dict[int, tuple[bytes, str]] = {}
        self.cache = Runs(self.run)
        self.old: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n, get, made = len(ids), self.merges.get, self.made
        ranks = [*map(get, zip(ids, ids[1:])), None]  # of the pair that begins at each symbol
        queue = [rank << 32 | i for i, rank in enumerate(ranks) if rank is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            lowest = heapq.heappop(queue)
            i = lowest & 0xFFFFFFFF
            if ranks[i] != lowest >> 32:  # stale: a neighbour has merged since
                continue
            j, new = after[i], made[lowest >> 32]
            ids[i], ids[j] = new, -1
            ranks[i] = ranks[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := get((new, ids[k]))) is not None:
                    ranks[i] = rank
                    heapq.heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                ranks[h] = rank = get((ids[h], new))
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | h)
        return [i for i in ids if i >= 0]

    def kept(self, word: str, out: tuple[bytes, str]) -> tuple[bytes, str]:
        if len(word) <= 64:
            if len(self.cache) >= CACHE_WORDS:
                self.old = dict(self.cache)
                self.cache.clear()
            self.cache[word] = out
        return out

    def word(self, word: str) -> tuple[bytes, str]:
        """The ids of one piece, as 32-bit numbers, and its decoded text."""
        out = self.cache.get(word)
        if out is None:
            out = self.old.get(word)
            if out is None:
                ids = self.merge(word)
                out = self.single.get(ids[0]) if len(ids) == 1 else None
                if out is None:
                    out = (array("i", ids).tobytes(), self.decode(ids))
                    if len(ids) == 1:  # bounded by the vocabulary: all words of one id share it
                        self.single[ids[0]] = out
            self.kept(word, out)
        return out

    def run(self, run: str) -> tuple[bytes, str]:
        """The same of a run without white space. No piece holds white space, and a piece alone is split no further, so
        runs and pieces share a cache."""
        out = self.old.get(run)
        if out is None:
            words = [run] if run.isascii() and run.isalpha() else self.split.findall(run)
            if len(words) == 1:
                return self.word(words[0])
            found = [self.word(w) for w in words]
            out = (b"".join([ids for ids, _ in found]), " ".join([t for _, t in found]))
        return self.kept(run, out)

    def normalise(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # Lower-casing goes letter by letter, so a final sigma gets no form of its own.
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """(ids as 32-bit numbers, decoded text) of each run without white space and of each special token."""
        parts, found = [text] if self.marks is None or "<" not in text else self.marks.split(text), []
        for part in parts:
            if part in self.special:
                found.append((array("i", [self.special[part]]).tobytes(), part))
            elif part:
                whole = self.normalise(part)
                found.extend(map(self.cache.__getitem__, self.runs.findall(whole) if SEPARATORS.search(whole) else whole.split()))
        return found

    def encode(self, text: str) -> list[int]:
        return array("i", b"".join([ids for ids, _ in self.pieces(text)])).tolist()

    def decode(self, ids) -> str:
        return " ".join(map(self.text.__getitem__, ids))


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` array<int> and ``decoded`` string. ``vocabulary``: a file's path that the driver can read (1.7 MB; it is
    broadcast once and each worker builds its tables from it)."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(data), ("bpe", hash(data))
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = StructType([*kept, StructField("ids", ArrayType(IntegerType(), False)), StructField("decoded", StringType())])
    names = [f.name for f in kept]

    def run(batches):
        bpe = held(key, lambda: WordBpe(json.loads(shared.value)))
        for b in chunks(batches, text, BATCH_BYTES):
            ids, ends, decoded = [], [0], []
            for t in b.column(text).to_pylist():
                found = bpe.pieces(t) if t else []
                ids.append(b"".join([x for x, _ in found]))
                ends.append(ends[-1] + len(ids[-1]) // 4)
                decoded.append(" ".join([s for _, s in found]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), lists, pa.array(decoded, pa.string())], [*names, "ids", "decoded"])

    return arrow_map(docs.select(*names), run, schema, keeps=key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: how many ids, and SHA-256 of the ids' decimal text and of the decoded text."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
