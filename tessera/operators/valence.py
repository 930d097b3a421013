"""Rule-based valence of texts over a user's table of (token, valence).

Every word is a row with the three words before it and the one after, cut within its text without a shuffle; the table is
joined by token, and one aggregation a text sums what the rules make of the words. The rules are the published ones for
short informal texts: boosters and dampers up to three words back, capitals among lower case, negations, "least", "but",
exclamation and question marks, and s / sqrt(s^2 + 15) as the compound. Idioms of several words are not known.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from tessera.storage import broadcast_if_small

# The published weights and word lists.
BOOST, CAPITALS, NEGATION, EXCLAMATION, QUESTION, QUESTIONS, ALPHA = 0.293, 0.733, -0.74, 0.292, 0.18, 0.96, 15.0
FADE = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
#: "never so", "never this" two and three words back.
NEVER_SO = (1.5, 1.25)
BOOSTERS = (
    "absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely fabulously fully greatly "
    "highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously "
    "uber unbelievably unusually utterly very"
).split()
DAMPERS = "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split()
NEGATIONS = "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neednt neither never no nobody none nope nor not nothing nowhere oughtnt rarely seldom shant shouldnt wasnt werent without wont wouldnt despite".split()

#: Tables of at most so many tokens are broadcast; larger ones shuffle.
BROADCAST_TOKENS = 200_000
SPACES = r"[ \t\n\x0B\f\r]+"


def _in(c: Column, words: list[str]) -> Column:
    return F.coalesce(c.isin(words), F.lit(False))


def _upper(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*$"), F.lit(False))


def words(text: Column) -> Column:
    """The text cut at white space; signs at a word's ends go where more than two characters remain."""
    def bare(x: Column) -> Column:
        y = F.btrim(x, F.lit(string.punctuation))
        return F.when(F.length(y) > 2, y).otherwise(x)

    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda x: x != ""), bare)


def _rows(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, marks, mixed, but, n, i, w, p1, p2, p3, after): a row a word, or one of nulls for a text without words."""
    t = df.select(F.col(id_).alias("id"), F.col(text).alias("t"), words(F.col(text)).alias("w"))
    shouts, asks = (F.length("t") - F.length(F.replace("t", F.lit(c), F.lit(""))) for c in "!?")
    marks = F.least(shouts, F.lit(4)) * EXCLAMATION + F.when(asks < 2, 0.0).when(asks <= 3, asks * QUESTION).otherwise(QUESTIONS)
    capitals = F.size(F.filter("w", _upper))
    t = t.select("id", "w", marks.alias("marks"), ((capitals > 0) & (capitals < F.size("w"))).alias("mixed"), (F.array_position(F.transform("w", F.lower), "but") - 1).alias("but"))
    none = F.lit(None).cast("string")
    shifted = [F.concat(F.array(*[none] * k), F.col("w")).alias(f"p{k}") for k in (1, 2, 3)]
    t = t.select("id", "marks", "mixed", "but", F.arrays_zip("w", *shifted, F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("after")).alias("z"), F.size("w").alias("n"))
    return t.select("id", "marks", "mixed", "but", "n", F.posexplode_outer(F.slice("z", F.lit(1), F.col("n"))).alias("i", "e")).select("id", "marks", "mixed", "but", "n", "i", "e.*")


def _ruled(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with ``v``, the valence of each word after all rules: only words that the table holds, and a text's first row."""
    own = F.lower("w")
    rows = rows.join(table.select(F.col("token").alias("_t"), F.col("valence").alias("_v")), own == F.col("_t"), "left").drop("_t")
    hit = F.col("_v").isNotNull()
    rows = rows.where(hit | (F.coalesce("i", F.lit(0)) == 0))
    for k in (1, 2, 3):
        known = table.select(F.col("token").alias("_t"))
        # Other words look up themselves: no rule reads what they find, and no null gathers them in one task.
        rows = rows.join(known, F.when(hit, F.lower(f"p{k}")).otherwise(own) == F.col("_t"), "left").withColumn(f"free{k}", F.col(f"p{k}").isNotNull() & F.col("_t").isNull()).drop("_t")
    low = {k: F.lower(f"p{k}") for k in (1, 2, 3)}
    silent = _in(own, BOOSTERS + DAMPERS) | ((own == "kind") & F.coalesce(F.lower("after") == "of", F.lit(False)))
    rows = rows.withColumn("v", F.when(~hit, 0.0).when(silent, 0.0).otherwise(F.col("_v")))
    rows = rows.withColumn("v", F.when((F.col("v") != 0) & F.col("mixed") & _upper(F.col("w")), F.col("v") + CAPITALS * F.signum("v")).otherwise(F.col("v")))
    negated = lambda k: _in(low[k], NEGATIONS) | F.coalesce(low[k].contains("n't"), F.lit(False))
    so = lambda k: _in(low[k], ["so", "this"])
    never = {2: _in(low[2], ["never"]) & so(1), 3: _in(low[3], ["never"]) & (so(2) | so(1))}
    doubt = {2: _in(low[2], ["without"]) & _in(low[1], ["doubt"]), 3: _in(low[3], ["without"]) & (_in(low[2], ["doubt"]) | _in(low[1], ["doubt"]))}
    for k in (1, 2, 3):
        sign = F.when(F.col("v") < 0, -1.0).otherwise(1.0)
        more = F.when(_in(low[k], BOOSTERS), BOOST).when(_in(low[k], DAMPERS), -BOOST)
        step = F.coalesce(sign * (more + F.when(F.col("mixed") & _upper(F.col(f"p{k}")), CAPITALS).otherwise(0.0)), F.lit(0.0)) * FADE[k - 1]
        factor = F.when(negated(k), NEGATION).otherwise(1.0)
        if k > 1:
            factor = F.when(never[k], NEVER_SO[k - 2]).when(doubt[k], 1.0).otherwise(factor)
        rows = rows.withColumn("v", F.when((F.col("v") != 0) & F.col(f"free{k}"), (F.col("v") + step) * factor).otherwise(F.col("v")))
    least = F.col("free1") & _in(low[1], ["least"]) & ~_in(low[2], ["at", "very"])
    place = F.when(F.col("but") < 0, 1.0).when(F.col("i") < F.col("but"), BEFORE_BUT).when(F.col("i") > F.col("but"), AFTER_BUT).otherwise(1.0)
    return rows.withColumn("v", F.when(F.col("v") == 0, 0.0).otherwise(F.col("v") * F.when(least, NEGATION).otherwise(1.0) * place))


def valence(df: DataFrame, id_: str, text: str, table: DataFrame) -> DataFrame:
    """(id, positive, negative, neutral, compound): shares to 3 places, the compound to 4; all null for a null or blank
    text. ``table``: (token, valence), tokens in lower case; one that stands twice counts with its mean, null ones not at
    all. ``id_`` is a key: texts of one id count as one. Other columns are dropped."""
    table = table.select(F.lower("token").alias("token"), F.col("valence").cast("double").alias("valence")).where("token is not null and valence is not null")
    table = broadcast_if_small(table.groupBy("token").agg(F.avg("valence").alias("valence")), BROADCAST_TOKENS)
    w = _ruled(_rows(df, id_, text), table)
    v = F.col("v")
    sums = w.groupBy("id").agg(
        F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n"))).alias("n"), F.max("marks").alias("m"), F.sum(v).alias("s"), F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("p"),
        F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("q"), F.count(F.when(v != 0, 1)).alias("z"),
    )
    sums = sums.withColumn("z", F.col("n") - F.col("z"))
    some = F.col("n") > 0
    total = F.col("s") + F.signum("s") * F.col("m")
    ahead = lambda a, b: (F.col(a) + F.when(F.col(a) > F.col(b), F.col("m")).otherwise(0.0)).alias(a)
    sums = sums.select("id", "n", "z", total.alias("t"), ahead("p", "q"), ahead("q", "p"))
    whole = F.col("p") + F.col("q") + F.col("z")
    share = lambda c: F.when(some, F.round(F.try_divide(F.col(c), whole), 3))
    return sums.select("id", share("p").alias("positive"), share("q").alias("negative"), share("z").alias("neutral"), F.when(some, F.round(F.col("t") / F.sqrt(F.col("t") * F.col("t") + ALPHA), 4)).alias("compound"))


def sql(documents: str, id_: str, text: str, table: dict[str, float]) -> str:
    """The same rows in DuckDB's SQL, for a table given as literals."""
    lists = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
    upper = lambda c: f"coalesce(regexp_matches({c}, '\\p{{Lu}}') and not regexp_matches({c}, '\\p{{Ll}}'), false)"
    is_in = lambda c, ws: f"coalesce({c} in {lists(ws)}, false)"
    neg = lambda k: f"({is_in(f'l{k}', NEGATIONS)} or coalesce(contains(l{k}, 'n''t'), false))"

    def step(k: int) -> str:
        more = f"case when {is_in(f'l{k}', BOOSTERS)} then {BOOST}::double when {is_in(f'l{k}', DAMPERS)} then -{BOOST}::double end"
        factor = f"when {neg(k)} then {NEGATION}::double else 1.0::double end"
        if k == 2:
            factor = f"when l2 = 'never' and {is_in('l1', ['so', 'this'])} then {NEVER_SO[0]}::double when l2 = 'without' and coalesce(l1 = 'doubt', false) then 1.0::double " + factor
        if k == 3:
            factor = f"when l3 = 'never' and ({is_in('l2', ['so', 'this'])} or {is_in('l1', ['so', 'this'])}) then {NEVER_SO[1]}::double when l3 = 'without' and (coalesce(l2 = 'doubt', false) or coalesce(l1 = 'doubt', false)) then 1.0::double " + factor
        add = f"coalesce(case when v < 0 then -1.0::double else 1.0::double end * ({more} + case when mixed and {upper(f'p{k}')} then {CAPITALS}::double else 0.0::double end), 0.0::double) * {FADE[k - 1]}::double"
        return f"r{k} as (select * replace (case when l{k} is not null and l{k} not in (select token from lex) and v <> 0 then (v + {add}) * case {factor} else v end as v) from r{k - 1})"

    values = ", ".join(f"('{t}', {v}::double)" for t, v in table.items())
    spaced = "'[ \\t\\n\\x0B\\f\\r]+'"
    bare = "regexp_replace(x, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')"
    lags = ", ".join(f"lag(w, {k}) over o p{k}, lower(lag(w, {k}) over o) l{k}" for k in (1, 2, 3))
    shouts, asks = (f"(length(t) - length(replace(t, '{c}', '')))" for c in "!?")
    return f"""
with lex(token, valence) as (values {values}),
a as (select {id_} id, coalesce({text}, '') t, list_transform(list_filter(regexp_split_to_array(coalesce({text}, ''), {spaced}), lambda x: x <> ''), lambda x: case when length({bare}) > 2 then {bare} else x end) w from {documents}),
b as (select id, w, least({shouts}, 4) * {EXCLAMATION}::double + case when {asks} < 2 then 0.0::double when {asks} <= 3 then {asks} * {QUESTION}::double else {QUESTIONS}::double end marks, len(list_filter(w, lambda x: {upper('x')})) capitals, coalesce(list_position(list_transform(w, lambda x: lower(x)), 'but'), 0) but from a),
c as (select id, capitals > 0 and capitals < len(w) mixed, but, unnest(w) w, generate_subscripts(w, 1) i from b),
d as (select *, lower(w) l0, {lags}, lower(lead(w, 1) over o) nx from c window o as (partition by id order by i)),
e as (select d.*, case when {is_in('l0', BOOSTERS + DAMPERS)} or (l0 = 'kind' and coalesce(nx = 'of', false)) then 0.0::double else coalesce(valence, 0.0::double) end v0 from d left join lex on token = l0),
r0 as (select *, v0 + case when mixed and {upper('w')} then {CAPITALS}::double * sign(v0) else 0.0::double end v from e),
{step(1)}, {step(2)}, {step(3)},
f as (select id, v * case when l1 = 'least' and 'least' not in (select token from lex) and not {is_in('l2', ['at', 'very'])} then {NEGATION}::double else 1.0::double end * case when but = 0 then 1.0::double when i < but then {BEFORE_BUT}::double when i > but then {AFTER_BUT}::double else 1.0::double end v from r3),
g as (select id, sum(v) s, sum(case when v > 0 then v + 1 else 0 end) p, sum(case when v < 0 then 1 - v else 0 end) q, count(*) filter (v = 0) z from f group by 1),
h as (select b.id, s + sign(s) * marks t, p + case when p > q then marks else 0 end p, q + case when q > p then marks else 0 end q, z from b left join g using (id))
select id as {id_}, round(p / (p + q + z), 3) positive, round(q / (p + q + z), 3) negative, round(z / (p + q + z), 3) neutral, round(t / sqrt(t * t + {ALPHA}::double), 4) compound from h"""
