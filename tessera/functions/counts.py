"""Counts a text over arrays of words or lines, in Arrow batches: repeats are found by sorting, and what a word is worth
(length, syllables, categories) once for each different word of a slice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words or lines that are counted at once, but for a longer text.
SLICE = 1 << 19
SUMS = ("letters_sum", "square_sum", "over_3", "over_6", "over_9", "syllables_sum", "hard", "plain_letters")
REPEATS = ("n", "unique", "once", "twice", "top", "five", "again")


def parts(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, pa.StringArray, np.ndarray]]:
    """(how many values each text has, the different values, the number of each value) of some texts at a time."""
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    whole, a, flat = np.cumsum(length), 0, lists.flatten()
    while a < len(lists):
        begin = whole[a - 1] if a else 0
        e = max(a + 1, int(np.searchsorted(whole, begin + SLICE, side="right")))
        coded = flat.slice(begin, whole[e - 1] - begin).dictionary_encode()
        yield length[a:e], coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        a = e


def repeats(length: np.ndarray, different: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """(text, value, count) of every different value of a text, the counts REPEATS of each text, and its most frequent value
    (the first of several; -1 of none)."""
    row = np.repeat(np.arange(len(length)), length)
    pair, first, count = np.unique(row * max(1, different) + code, return_index=True, return_counts=True)
    text, value = pair // max(1, different), pair % max(1, different)
    order = np.lexsort((first, -count, text))
    start = np.searchsorted(text, np.arange(len(length)))
    place = np.arange(len(text)) - start[text]
    of = lambda at, w=None: np.bincount(text[at] if w is None else text[order][at], w, len(length)).astype(np.int64)
    some, top, best = length > 0, np.zeros(len(length), np.int64), np.full(len(length), -1)
    top[some], best[some] = count[order][start[some]], value[order][start[some]]
    five = of(place < 5, count[order][place < 5])
    return text, value, count, dict(zip(REPEATS, (length.astype(np.int64), of(slice(None)), of(count == 1), of(count == 2), top, five, of(count > 1)), strict=True)), best


def worth(words: pa.StringArray, groups: Mapping[str, Iterable[str]]) -> dict[str, np.ndarray]:
    """N7, N10, N12, N15 of lower-case words of a-z with at most one apostrophe."""
    whole = lambda c: c.to_numpy(zero_copy_only=False).astype(np.int64)
    bare = pc.replace_substring(words, "'", "")
    size, letters, vowels = whole(pc.utf8_length(words)), whole(pc.utf8_length(bare)), whole(pc.count_substring_regex(bare, "[aeiouy]+"))
    spoken = vowels - whole(pc.ends_with(bare, "e")) * (vowels > 1) + whole(pc.match_substring_regex(bare, "[^aeiouy]le$"))
    spoken = np.where(letters == 0, 0, np.where(letters <= 3, 1, np.maximum(1, spoken)))
    out = dict(zip(SUMS, (size, size * size, size >= 4, size >= 7, size >= 10, spoken, spoken >= 3, letters), strict=True))
    return out | {name: whole(pc.is_in(words, value_set=pa.array(list(members), words.type))) for name, members in groups.items()}


def counted(df, words: str, lines: str, groups: Mapping[str, Iterable[str]]):
    """``df`` with longs in place of the arrays: w_ and l_ before REPEATS of the words and lines, SUMS, the words of each of
    ``groups``, and the word that stands most often as ``top_token``."""
    kept = [c for c in df.columns if c not in (words, lines)]
    longs = [*(f"w_{c}" for c in REPEATS), *SUMS, *groups, *(f"l_{c}" for c in REPEATS)]
    given = {k: list(v) for k, v in groups.items()}

    def run(batches):
        for batch in batches:
            column, found, tops = dict(zip(batch.schema.names, batch.columns, strict=True)), {c: [] for c in longs}, []
            for length, different, code in parts(column[words]):
                text, value, count, each, best = repeats(length, len(different), code)
                for c, v in each.items():
                    found[f"w_{c}"].append(v)
                for c, v in worth(different, given).items():
                    found[c].append(np.bincount(text, count * v[value], len(length)).astype(np.int64))
                tops.append(different.take(pa.array(best, mask=best < 0)))
            for length, different, code in parts(column[lines]):
                for c, v in repeats(length, len(different), code)[3].items():
                    found[f"l_{c}"].append(v)
            out = [*(column[c] for c in kept), *(pa.array(np.concatenate(found[c])) for c in longs), pa.concat_arrays(tops)]
            yield pa.RecordBatch.from_arrays(out, [*kept, *longs, "top_token"])

    types = dict(df.dtypes)
    return df.mapInArrow(lambda batches: run(b for b in batches if b.num_rows), ", ".join((*(f"`{c}` {types[c]}" for c in kept), *(f"`{c}` long" for c in longs), "top_token string")))
