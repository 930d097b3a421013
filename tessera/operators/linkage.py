"""Record linkage: pairs of similar texts that no filter can lose, and the best match of every record.

Similar texts. The ratio is 200 * LCS / (len a + len b). With a mark at either end, a text of n signs has n + 1 bigrams;
a sign that the other text lacks spoils two of its own, one that the other text has besides spoils one more, so two texts
share at least 3 LCS - len a - len b + 1 bigrams (as multisets). For a ratio of r or more that is
(1.5 r / 100 - 1) * (len a + len b) + 1: above zero for every r above 66.7, whether they share a word or not. Hence

* length filter: the longer has at most (200 - r) / r times the signs of the shorter;
* prefix filter: of two texts that must share k of their bigrams, each has one of the shared ones among all but its k - 1
  commonest; the order is from rare to common, so common bigrams are seldom met;
* hot bigrams are dealt into blocks that meet block to block, so no task holds all texts of one;
* count filter on the whole multisets, then the ratio itself.

A pair that shares several prefix bigrams is kept at the first of them only, so nothing is deduplicated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.scores import FILE_WEIGHTS, fuzzy_ratio, match_score, match_status, step_score
from tessera.operators import tables as O
from tessera.storage import contained, materialize

#: Texts of one bigram that a block holds.
BLOCK = 2000
#: The steps of the difference score reach so far.
REACH = 40


def bigrams(text: Column) -> Column:
    """The bigrams of a text between two marks, each with the number of its occurrence, so that sets compare as multisets."""
    marked = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    plain = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(marked, i, F.lit(2)))
    return F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, 1, i + 1), lambda x: x == g)).cast("string")))


@contained
def similar_texts(texts: DataFrame, text: str = "text", least: float = 75.0) -> DataFrame:
    """(a, b, ratio) of all distinct texts a < b whose ratio is ``least`` or more (above 200 / 3).

    Null texts take no part; an empty text is similar to no other. Other columns are not read.
    """
    if not 200 / 3 < least <= 100:
        raise ValueError("bigrams cannot find pairs of a ratio of 66.7 or less")
    share = 1.5 * least / 100 - 1
    need = lambda n: F.ceil(n * share + 1 - 1e-9).cast("int")  # noqa: E731  shared bigrams of texts of n signs together
    t = materialize(texts.select(F.col(text).alias("t")).where("t is not null").distinct().select("t", F.length("t").alias("n"), bigrams(F.col("t")).alias("g")), "texts")
    counts = t.select(F.explode("g").alias("e")).groupBy("e").agg(F.count("*").alias("c"))
    ranked = materialize(O.global_rank(counts, F.struct("c", "e"), "place"), "bigrams")
    owned = t.select("t", "n", F.explode("g").alias("e")).join(ranked, "e").groupBy("t", "n").agg(F.array_sort(F.collect_list("place")).alias("g"))  # of one text: as long as it
    shortest = F.ceil(F.col("n") * least / (200 - least) - 1e-9)
    owned = materialize(owned.withColumn("p", F.slice("g", F.lit(1), F.greatest(F.lit(1), F.size("g") - need(F.col("n") + shortest) + 1))), "owned")
    in_prefix = owned.select("t", "n", "g", "p", F.explode("p").alias("e"))
    size = in_prefix.groupBy("e").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = in_prefix.join(size, "e", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("t", "n", "g", "p", "e", "own", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
    left, right = dealt.where("own = x"), dealt.where("own = y")
    j = left.alias("l").join(right.alias("r"), ["e", "x", "y"]).where("(x < y or l.t < r.t)")
    near = (F.least("l.n", "r.n") * (200 - least) + 1e-9 >= F.greatest("l.n", "r.n") * least) & (F.array_min(F.array_intersect("l.p", "r.p")) == F.col("e"))
    shared = F.size(F.array_intersect("l.g", "r.g")) >= need(F.col("l.n") + F.col("r.n"))
    pairs = j.where(near).where(shared).select(F.least("l.t", "r.t").alias("a"), F.greatest("l.t", "r.t").alias("b"))
    return pairs.withColumn("ratio", fuzzy_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)


def _two(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return O.top_n_per_group(df, keys, list(order), 2).drop("rank")


@contained
def best_matches(records: DataFrame, key: str, title: str, album: str, size: str, has_text: Column, least: float = 75.0) -> DataFrame:
    """(key, matched, score, status): for each record the best other one whose title is similar (``least``).

    Candidates with text come first (if there is one, only those count), then the weighted score of title, album and
    difference of size, then the smaller key; the score of one with text has a bonus of 5 where candidates are compared,
    not in the result. Status: not_found, no_lyrics, matched, review.

    Records are compared by their distinct (title, album, size, text), and two candidates are kept of each, since a
    record passes over at most one, itself. Records without a title are not found; a null album scores 0, a null size 50; rows that
    repeat a key are one record, the first by its values; rows without a key take no part.
    """
    r = records.select(F.col(key).alias("k"), F.col(title).alias("t"), F.col(album).alias("a"), F.col(size).cast("int").alias("z"), F.coalesce(has_text, F.lit(False)).alias("x")).where("k is not null")
    r = materialize(r.groupBy("k").agg(F.min(F.struct("t", "a", "z", "x")).alias("v")).select("k", "v.*"), "records")
    pairs = similar_texts(r, "t", least)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio")).unionByName(r.where("t is not null").select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(100.0).alias("ratio")).distinct())
    held = materialize(_two(r.where("t is not null"), ["t", "a", "z", "x"], F.col("k")).select("t", "a", "z", "x", "k"), "held")
    group = ["t", "a", "x"]
    # Sources: each title, album and size, with the groups of candidates that are in reach.
    asked = held.select("t", "a", "z").distinct()
    groups = held.select(F.col("t").alias("b"), F.col("a").alias("ga"), "x").distinct()
    reach = asked.join(both.withColumnRenamed("a", "t"), "t").join(groups, "b")
    albums = materialize(reach.select("a", "ga").distinct().withColumn("like", F.coalesce(fuzzy_ratio(F.col("a"), F.col("ga")), F.lit(0.0))), "albums")
    # Candidates of a group by the asked size: those within the steps, those without a size, and any two.
    offered = held.withColumnRenamed("z", "own").withColumn("z", F.explode(F.sequence(F.col("own") - REACH, F.col("own") + REACH))).join(asked.select("z").distinct(), "z", "left_semi")
    offered = _two(offered.withColumn("step", step_score(F.col("own") - F.col("z"))), [*group, "z"], F.desc("step"), F.col("k")).select(*group, "z", "k", "step")
    unsized = _two(held.where("z is null"), group, F.col("k")).select(*group, "k", F.lit(50.0).alias("step"))
    every = _two(held, group, F.col("k")).select(*group, "k")
    as_group = lambda df: df.withColumnsRenamed({"t": "b", "a": "ga", "z": "gz"})
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("b", "ga", "x")]
    s = materialize(reach, "reach").alias("s")
    parts = [
        s.join(as_group(offered).alias("g"), [*same, F.col("s.z") == F.col("g.gz")]),
        s.join(as_group(unsized).alias("g"), same),
        s.join(as_group(every.withColumn("step", F.lit(50.0))).alias("g"), [*same, F.col("s.z").isNull()]),
        s.join(as_group(every.withColumn("step", F.lit(0.0))).alias("g"), [*same, F.col("s.z").isNotNull()]),
    ]
    found = parts[0].select("s.t", "s.a", "s.z", "s.x", "s.ga", "s.ratio", "g.k", "g.step")
    for p in parts[1:]:
        found = found.unionByName(p.select("s.t", "s.a", "s.z", "s.x", "s.ga", "s.ratio", "g.k", "g.step"))
    found = found.alias("f").join(albums.alias("l"), F.col("f.a").eqNullSafe(F.col("l.a")) & F.col("f.ga").eqNullSafe(F.col("l.ga"))).select("f.t", "f.a", "f.z", "f.x", "f.k", F.round(match_score({"title": F.col("f.ratio"), "album": F.col("l.like"), "duration": F.col("f.step")}, FILE_WEIGHTS), 6).alias("score"))
    found = found.groupBy("t", "a", "z", "k").agg(F.max("score").alias("score"), F.max("x").alias("x"))  # a key's own step is its best offer
    top = O.top_n_per_group(found.withColumn("chosen", F.col("score") + F.when(F.col("x"), 5.0).otherwise(0.0)), ["t", "a", "z"], [F.desc("x"), F.desc("chosen"), F.col("k")], 2)
    at = lambda n: F.max(F.when(F.col("rank") == n, F.struct("k", "score", "x")))
    top = top.groupBy("t", "a", "z").agg(at(1).alias("one"), at(2).alias("two"))
    m = r.alias("r").join(top.alias("c"), F.col("r.t").eqNullSafe(F.col("c.t")) & F.col("r.a").eqNullSafe(F.col("c.a")) & F.col("r.z").eqNullSafe(F.col("c.z")), "left")
    best = F.when(F.col("c.one.k") != F.col("r.k"), F.col("c.one")).otherwise(F.col("c.two"))
    return m.select(F.col("r.k").alias(key), best.alias("m")).select(key, F.col("m.k").alias("matched"), "m.score", match_status(F.col("m.score"), F.col("m.x")).alias("status"))
