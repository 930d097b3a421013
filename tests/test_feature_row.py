"""The wide row of text features: one pass over words and lines, equal to the tables that it stands for."""

from functools import reduce

import pyarrow as pa
import pytest

from tessera.functions import counts
from tessera.plans import texts as X

TEXTS = [
    None, "", "   \n\n ", "Numb. I can't\nfeel, I can't feel!\n\nfeel", "don't DON'T don't rock'n'roll o'clock'", "a\rb\x0bc d. e? the table little people, people; time… rage love love",
    "Straße naïve Ünder x_y 4you you4 héllo hello", "line one\nLine one!\nline  one\nother", "but very GOOD and not bad, never so good but hate!!! ??", "one two. Two one\x85three three",
]


def write(spark, folder, ids):
    spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("ids", [list(range(10)), [None, *range(9)], [1, 1, *range(2, 10)]])
def test_equal_to_the_tables_joined(spark, tmp_path, monkeypatch, ids):
    folder = write(spark, str(tmp_path), ids)
    want = reduce(lambda a, b: a.join(b, "doc_id", "left"), [getattr(X, n)(spark, folder) for n in X.FEATURE_TABLES])
    found = X.doc_feature_row(spark, folder)
    assert found.dtypes == want.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_words_are_counted_in_one_pass(spark, tmp_path):
    """Each of eight tables cut the texts itself, and seven joins put them together."""
    plan = X.doc_feature_row(spark, write(spark, str(tmp_path), range(10)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join LeftOuter") <= 5  # one, and those of the valences' table


def test_slices_keep_every_text():
    lists = pa.array([["b", "a", "b"], [], None, ["a"], ["c", "c", "a", "a", "d"]], pa.list_(pa.string()))
    for size in (1, 3, 100):
        counts.SLICE, kept = size, counts.SLICE
        try:
            got = [(n, w.to_pylist(), c.tolist()) for n, w, c in counts.parts(lists)]
            rows, tops = [], []
            for length, words, code in got:
                _, _, _, each, best = counts.repeats(length, len(words), code)
                rows += list(zip(*(each[k].tolist() for k in counts.REPEATS), strict=True))
                tops += [words[b] if b >= 0 else None for b in best]
        finally:
            counts.SLICE = kept
        assert tops == ["b", None, None, "a", "c"]
        assert rows == [(3, 2, 1, 1, 2, 3, 1), (0,) * 7, (0,) * 7, (1, 1, 1, 0, 1, 1, 0), (5, 3, 1, 2, 2, 5, 2)]
