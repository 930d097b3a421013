"""Queries over texts and titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import counts, lexicon, text as T
from tessera.operators import valence
from tessera.storage import table

R6 = lambda c: F.round(c, 6)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _lexical(columns: dict) -> list:
    return [R6(c).alias(n) if "ratio" in n or "mean" in n or "std" in n or "proxy" in n else c.cast("long").alias(n) for n, c in columns.items()]


def doc_token_stats(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"))
    return d.select("doc_id", *_lexical(T.lexical("w")))


def doc_hapax(spark, sf_dir):
    """Words that occur once and twice; one grouping a document inside its row, by sorting its tokens."""
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.tokens("text")).alias("pos", "w"))
    per_word = d.groupBy("doc_id", "w").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    return per_word.groupBy("doc_id").agg(
        F.count_if(F.col("c") == 1).alias("hapax_count"), F.count_if(F.col("c") == 2).alias("dis_legomena_count"),
        F.min_by("w", F.struct(-F.col("c"), "first")).alias("top_token"), F.max("c").alias("top_token_count"), F.sum("c").alias("n"),
        F.aggregate(F.slice(F.sort_array(F.collect_list("c"), asc=False), 1, 5), F.lit(0).cast("long"), lambda a, x: a + x).alias("five"),
    ).select(
        "doc_id", "hapax_count", R6(T.ratio(F.col("hapax_count"), F.col("n"))).alias("hapax_ratio"), "dis_legomena_count", R6(T.ratio(F.col("dis_legomena_count"), F.col("n"))).alias("dis_legomena_ratio"),
        "top_token", "top_token_count", R6(T.ratio(F.col("five"), F.col("n"))).alias("top_5_word_share"),
    )


def doc_structure_stats(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("s", T.sentences("t"))
    words = lambda c: F.transform(c, lambda x: F.size(T.tokens(x)))
    return d.withColumn("sw", words(F.col("s"))).withColumn("lw", words(T.lines("t"))).select("doc_id", *_structure())


def _structure() -> list:
    """Columns over a text t, its sentences s, and the words of each of its sentences (sw) and lines (lw)."""
    (line_mean, line_std), (sentence_mean, sentence_std) = T.spread("lw"), T.spread("sw")
    n = F.length("t")
    upper, letters = F.regexp_count("t", F.lit(r"\p{Lu}")), F.regexp_count("t", F.lit(r"\p{L}"))
    marks = F.regexp_count("t", F.lit(r"[^\p{L}\p{N}\s]"))
    out = {
        "character_count": n, "line_count": F.size("lw"), "max_words_in_line": F.coalesce(F.array_max("lw"), F.lit(0)), "min_words_in_line": F.coalesce(F.array_min("lw"), F.lit(0)), "sentence_count": F.size("s"), "question_mark_count": T.count_of("t", "?"), "exclamation_mark_count": T.count_of("t", "!"),
        "comma_count": T.count_of("t", ","), "semicolon_count": T.count_of("t", ";"), "colon_count": T.count_of("t", ":"), "apostrophe_count": T.count_of("t", "'"),
        "digit_count": F.regexp_count("t", F.lit("[0-9]")), "ellipsis_count": F.regexp_count("t", F.lit(r"\.\.\.|…")), "blank_line_runs": F.regexp_count("t", F.lit(r"\n[ \t]*\n")),
    }
    return [*(c.cast("long").alias(k) for k, c in out.items()), R6(T.ratio(marks, n)).alias("punctuation_density"), R6(T.ratio(upper, letters)).alias("uppercase_ratio"),
        R6(line_mean).alias("avg_words_per_line"), R6(line_std).alias("line_word_count_std"), R6(sentence_mean).alias("avg_words_per_sentence"), R6(sentence_std).alias("sentence_word_count_std")]


def _plain_line(line):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}_\s']", ""), r"\s+", " "))


def doc_line_repetition(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", _plain_line("line").alias("line")).where("line <> ''")
    c = d.groupBy("doc_id", "line").agg(F.count("*").alias("c")).groupBy("doc_id").agg(
        F.count("*").alias("unique_line_count"), F.sum(F.col("c") - 1).alias("duplicate_line_occurrences"), F.count_if(F.col("c") > 1).alias("duplicate_line_types"),
        F.sum("c").alias("n"), F.max("c").alias("most_repeated_line_count"),
    )
    return c.withColumn("line_repetition_ratio", R6(T.ratio(F.col("duplicate_line_occurrences"), F.col("n")))).drop("n")


def doc_lexicon_ratios(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"))
    out = []
    for name in lexicon.CATEGORIES:
        hits = T.lexicon_count("w", lexicon.words(name))
        out += [hits.cast("long").alias(f"{name}_count"), R6(T.ratio(hits, F.size("w"))).alias(f"{name}_ratio")]
    return d.select("doc_id", *out)


def doc_emotions(spark, sf_dir):
    """Counts and ratios by an (emotion, token) table; the library's small table stands in for the user's."""
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"))
    out = []
    for name in lexicon.EMOTIONS:
        hits = T.lexicon_count("w", lexicon.EMOTION_WORDS[name].split())
        out += [hits.cast("long").alias(f"{name}_count"), R6(T.ratio(hits, F.size("w"))).alias(f"{name}_ratio")]
    return d.select("doc_id", *out)


def doc_sentiment(spark, sf_dir):
    """Rule-based valence by a (token, valence) table; the library's small table stands in for the user's."""
    words = spark.createDataFrame(list(lexicon.VALENCES.items()), "token string, valence double")
    return valence.valence(_docs(spark, sf_dir), "doc_id", "text", words).withColumnRenamed("id", "doc_id")


def doc_readability(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"), F.size(T.sentences("text")).alias("n"))
    return d.select("doc_id", *(c.alias(k) for k, c in T.readability("w", F.col("n")).items()))


#: The queries whose columns make up the wide row; each has one row a document, or none where it has no words or lines.
FEATURE_TABLES = ("doc_token_stats", "doc_structure_stats", "doc_readability", "doc_lexicon_ratios", "doc_hapax", "doc_line_repetition", "doc_emotions", "doc_sentiment")


def doc_feature_row(spark, sf_dir):
    """All features of a document as one wide row; what a document without words or lines lacks is null.

    The words are cut once, by sentence, and all that is counted of words and lines comes from one pass over these arrays;
    only the valences are joined. Documents without an id or of repeated ids need the tables joined, as their twin does."""
    d = _docs(spark, sf_dir)
    if d.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        return reduce(lambda a, b: a.join(b, "doc_id", "left"), [globals()[name](spark, sf_dir) for name in FEATURE_TABLES])
    # No word crosses the end of a sentence or line, so the words of a text are those of its sentences.
    d = d.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("s", T.sentences("t")).withColumn("sentence_words", F.transform("s", T.tokens))
    d = d.withColumn("sw", F.transform("sentence_words", F.size)).withColumn("lw", F.transform(T.lines("t"), lambda x: F.regexp_count(F.lower(x), F.lit(T.WORD))))
    plain = F.filter(F.transform(F.split("t", "\n"), _plain_line), lambda x: x != "")
    d = d.select("doc_id", *_structure(), F.flatten("sentence_words").alias("words"), plain.alias("lines"))
    structure = d.columns[1:-2]
    lists = {name: lexicon.words(name) for name in lexicon.CATEGORIES} | {f"emotion_{name}": lexicon.EMOTION_WORDS[name].split() for name in lexicon.EMOTIONS}
    d = counts.counted(d, "words", "lines", {f"in_{k}": v for k, v in lists.items()})
    n, lines, c = F.col("w_n"), F.col("l_n"), F.col
    some = lambda x: F.when(n > 0, x)
    filled = lambda x: F.when(lines > 0, x)
    listed = lambda names, before: [x for k in names for x in (c(f"in_{before}{k}").alias(f"{k}_count"), R6(T.ratio(c(f"in_{before}{k}"), n)).alias(f"{k}_ratio"))]
    d = d.select(
        "doc_id", *_lexical(T.lexical_of(n, c("w_unique"), T.ratio(c("letters_sum"), n), T.ratio(c("square_sum"), n), c("over_3"), c("over_6"), c("over_9"))), *structure,
        *(x.alias(k) for k, x in T.readability_of(n, c("syllables_sum"), c("hard"), c("plain_letters"), c("sentence_count")).items()), *listed(lexicon.CATEGORIES, ""),
        some(c("w_once")).alias("hapax_count"), some(R6(T.ratio(c("w_once"), n))).alias("hapax_ratio"), some(c("w_twice")).alias("dis_legomena_count"), some(R6(T.ratio(c("w_twice"), n))).alias("dis_legomena_ratio"),
        "top_token", some(c("w_top")).alias("top_token_count"), some(R6(T.ratio(c("w_five"), n))).alias("top_5_word_share"),
        filled(c("l_unique")).alias("unique_line_count"), filled(lines - c("l_unique")).alias("duplicate_line_occurrences"), filled(c("l_again")).alias("duplicate_line_types"), filled(c("l_top")).alias("most_repeated_line_count"),
        filled(R6(T.ratio(lines - c("l_unique"), lines))).alias("line_repetition_ratio"), *listed(lexicon.EMOTIONS, "emotion_"),
    )
    return d.join(doc_sentiment(spark, sf_dir), "doc_id", "left")


def doc_feature_coverage(spark, sf_dir):
    """Of every feature the documents that have it, and their share."""
    row = doc_feature_row(spark, sf_dir)
    names = [c for c in row.columns if c != "doc_id"]
    found = row.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in names)).unpivot(["n"], names, "feature", "documents")
    return found.select("feature", "documents", R6(F.col("documents") / F.col("n")).alias("share"))


def clean_text_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean_lines("text").cast("binary")).alias("clean_md5"), F.length(T.clean_lines("text")).cast("long").alias("clean_chars"))


def clean_accounting(spark, sf_dir):
    """Characters and filled lines before and after cleaning."""
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("a"), T.clean_lines("text").alias("b"))
    filled = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")).cast("long")
    return d.select(
        "doc_id", F.length("a").cast("long").alias("raw_characters"), F.length("b").cast("long").alias("clean_characters"), filled(F.col("a")).alias("raw_lines"), filled(F.col("b")).alias("clean_lines"),
        (F.length("a") - F.length("b")).cast("long").alias("removed_characters"), (filled(F.col("a")) - filled(F.col("b"))).alias("removed_lines"),
        F.size(T.tokens("a")).cast("long").alias("raw_words"), F.size(T.tokens("b")).cast("long").alias("clean_words"), (F.size(T.tokens("a")) - F.size(T.tokens("b"))).cast("long").alias("removed_words"),
    )


def title():
    end = F.when(F.col("p_partkey") % 4 == 0, "(Live at Venue)").when(F.col("p_partkey") % 4 == 1, "- Remastered 2012").when(F.col("p_partkey") % 4 == 2, "[Demo]").otherwise("(Reprise)")
    return F.concat(F.col("p_name"), F.lit(" "), end)


SQL_TITLE = "p_name || ' ' || case p_partkey % 4 when 0 then '(Live at Venue)' when 1 then '- Remastered 2012' when 2 then '[Demo]' else '(Reprise)' end"


def title_canonicalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.canonical_title(title()).alias("canonical"), T.match_title(title()).alias("match_title"), T.slug(title()).alias("slug"), T.song_key(title()).alias("song_key"))


def version_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in T.version_flags(title()).items()), (F.col("p_size") > 40).alias("is_bonus"))


def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.plain_punctuation(T.collapse(F.lower("text"))).cast("binary")).alias("normal_md5"), T.drop_featuring(F.concat(T.collapse(F.col("text")), F.lit(" Feat. X"))).alias("without_feat"))


def surrogate_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.format_string("tr-%02d-%03d", F.year("o_orderdate") % 100, F.col("o_orderkey") % 1000).alias("key"),
        (F.floor(F.col("o_totalprice") / 10.0 + 0.5) / 100.0).alias("seconds"), F.coalesce(F.nullif(F.trim(F.substring("o_orderpriority", 3, 20)), F.lit("")), F.lit("none")).alias("priority"),
        F.year(F.try_to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("yyyy-MM-dd"))).cast("long").alias("year"),
    )


def label_render(spark, sf_dir):
    """pretty labels and signed feature lists."""
    o = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("lyrics_"), F.lower("c_mktsegment"), F.lit("_ratio")).alias("f"), "c_acctbal", "c_nationkey")
    pairs = F.array(F.struct(F.lit("balance").alias("name"), F.col("c_acctbal").cast("double").alias("value")), F.struct(F.lit("nation").alias("name"), (-F.col("c_nationkey").cast("double")).alias("value")))
    return o.select("c_custkey", T.pretty_label("f", "lyrics_", "_ratio").alias("label"), T.signed_list(pairs, 2).alias("listed"))


_TOK = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)*'), lambda x: regexp_full_match(x, '[a-z]+(''[a-z]+)?'))"
_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')"
_D = "(select doc_id, text from documents)"
_LINES = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+|[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', '', 'g')), lambda x: x <> '')"
_tok = lambda name: _TOK.replace("coalesce(text, '')", name)


def _lex_sql(groups: dict[str, list[str]]) -> str:
    cols = []
    for name, members in groups.items():
        listed = ", ".join("'" + m.replace("'", "''") + "'" for m in members)
        hits = f"len(list_filter(w, lambda x: list_contains([{listed}], x)))"
        cols += [f"{hits}::bigint {name}_count", f"round(coalesce({hits}::double / nullif(len(w), 0), 0), 6) {name}_ratio"]
    return f"select doc_id, {', '.join(cols)} from (select doc_id, {_TOK} w from {_D})"


_SQL_PUNCT = "text"
for _old, _new in T.PUNCTUATION.items():
    _SQL_PUNCT = f"replace({_SQL_PUNCT}, '{_old}', '{_new.replace(chr(39), chr(39) * 2)}')"
_CLEAN = rf"""regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(replace(replace({_SQL_PUNCT.replace("replace(text", "replace(coalesce(text, '')", 1)}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
  lambda x: trim(regexp_replace(regexp_replace(x, '^\s*\[\d{{1,2}}:\d{{2}}(?:\.\d{{1,3}})?\]\s*', ''), '[ \t]+', ' ', 'g'))),
  lambda x: x = '' or not ((regexp_matches(x, '^[\[\(\{{].{{0,80}}[\]\)\}}]$') and regexp_matches(x, '(?i)\b(?:{T.SECTION_WORDS})\b')) or regexp_matches(x, '(?i){T.CREDITS}'))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
_CANON = rf"""trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace({SQL_TITLE}, '\s+', ' ', 'g'), '(?i)\s*[\(\[][^)\]]*\b(?:{T.VERSION_WORDS})\b[^)\]]*[\)\]]\s*$', '')), '(?i)\s+[-–—]\s+.*\b(?:{T.VERSION_WORDS})\b.*$', ''), '\s+', ' ', 'g'))"""
_MATCH = rf"trim(regexp_replace(regexp_replace(replace(lower({_CANON}), '&', ' and '), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_CNT = lambda s: f"(length(t) - length(replace(t, '{s}', '')))::bigint"

SQL = {
    "doc_token_stats": f"""
with t as (select doc_id, {_TOK} w from {_D}),
n as (select *, len(w) n, len(list_distinct(w)) v, list_transform(w, lambda x: length(x)) s from t),
m as (select *, coalesce(list_sum(s)::double / nullif(n, 0), 0) mean from n)
select doc_id, n::bigint word_count, v::bigint unique_word_count, round(coalesce(v::double / nullif(n, 0), 0), 6) type_token_ratio,
 round(coalesce(v / nullif(sqrt(n::double), 0), 0), 6) root_type_token_ratio, round(coalesce(v / nullif(sqrt(2.0::double * n), 0), 0), 6) corrected_type_token_ratio,
 (n - v)::bigint repeated_word_occurrences, round(coalesce((n - v)::double / nullif(n, 0), 0), 6) token_repetition_ratio, round(mean, 6) mean_word_length, round(coalesce(sqrt(list_sum(list_transform(s, lambda x: (x - mean) * (x - mean))) / nullif(n, 0)), 0), 6) std_word_length,
 len(list_filter(s, lambda x: x >= 7))::bigint long_word_count, len(list_filter(s, lambda x: x >= 10))::bigint very_long_word_count,
 round(coalesce(len(list_filter(s, lambda x: x >= 7))::double / nullif(n, 0), 0), 6) long_word_ratio, round(coalesce(len(list_filter(s, lambda x: x >= 10))::double / nullif(n, 0), 0), 6) very_long_word_ratio,
 round(coalesce(len(list_filter(s, lambda x: x >= 4))::double / nullif(n, 0), 0), 6) lexical_density_proxy from m""",
    "doc_hapax": f"""
with t as (select doc_id, {_TOK} w from {_D}), e as (select doc_id, unnest(w) w, generate_subscripts(w, 1) pos from t),
c as (select doc_id, w, count(*) c, min(pos) first from e group by 1, 2)
select doc_id, count(*) filter (c = 1) hapax_count, round(count(*) filter (c = 1) / sum(c)::double, 6) hapax_ratio, count(*) filter (c = 2) dis_legomena_count, round(count(*) filter (c = 2) / sum(c)::double, 6) dis_legomena_ratio,
 first(w order by c desc, first) top_token, max(c) top_token_count, round(list_sum((array_agg(c order by c desc))[1:5])::double / sum(c)::double, 6) top_5_word_share from c group by 1""",
    "doc_structure_stats": rf"""
with c as (select doc_id, text, coalesce(text, '') t, list_transform({_SENT}, lambda y: len({_tok('y')})) sw, list_transform({_LINES}, lambda y: len({_tok('y')})) lw from {_D}),
d as (select *, coalesce(list_avg(sw), 0) sm, coalesce(list_avg(lw), 0) lm from c)
select doc_id, len(lw)::bigint line_count, coalesce(list_max(lw), 0)::bigint max_words_in_line, coalesce(list_min(lw), 0)::bigint min_words_in_line, round(lm, 6) avg_words_per_line, round(sm, 6) avg_words_per_sentence,
 round(coalesce(sqrt(list_avg(list_transform(lw, lambda x: (x - lm) * (x - lm)))), 0), 6) line_word_count_std, round(coalesce(sqrt(list_avg(list_transform(sw, lambda x: (x - sm) * (x - sm)))), 0), 6) sentence_word_count_std,
 length(t)::bigint character_count, len({_SENT})::bigint sentence_count, {_CNT('?')} question_mark_count, {_CNT('!')} exclamation_mark_count, {_CNT(',')} comma_count,
 {_CNT(';')} semicolon_count, {_CNT(':')} colon_count, {_CNT("''")} apostrophe_count, len(regexp_extract_all(t, '[0-9]'))::bigint digit_count,
 len(regexp_extract_all(t, '\.\.\.|…'))::bigint ellipsis_count, len(regexp_extract_all(t, '\n[ \t]*\n'))::bigint blank_line_runs,
 round(coalesce(len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\s]'))::double / nullif(length(t), 0), 0), 6) punctuation_density,
 round(coalesce(len(regexp_extract_all(t, '\p{{Lu}}'))::double / nullif(len(regexp_extract_all(t, '\p{{L}}')), 0), 0), 6) uppercase_ratio from d""",
    "doc_line_repetition": rf"""
with e as (select doc_id, unnest(string_split(text, chr(10))) l from {_D}),
n as (select doc_id, trim(regexp_replace(regexp_replace(lower(l), '[^\p{{L}}\p{{N}}_\s'']', '', 'g'), '\s+', ' ', 'g')) l from e),
c as (select doc_id, l, count(*) c from n where l <> '' group by 1, 2)
select doc_id, count(*) unique_line_count, sum(c - 1)::bigint duplicate_line_occurrences, count(*) filter (c > 1) duplicate_line_types,
 max(c) most_repeated_line_count, round(coalesce(sum(c - 1)::double / nullif(sum(c), 0), 0), 6) line_repetition_ratio from c group by 1""",
    "doc_lexicon_ratios": _lex_sql({k: lexicon.words(k) for k in lexicon.CATEGORIES}),
    "doc_emotions": _lex_sql({k: lexicon.EMOTION_WORDS[k].split() for k in lexicon.EMOTIONS}),
    "doc_sentiment": valence.sql(_D, "doc_id", "text", lexicon.VALENCES),
    "doc_readability": rf"""
with t as (select doc_id, {_TOK} w, len({_SENT}) ns from {_D}),
c as (select *, list_transform(w, lambda x: regexp_replace(x, '[^a-z]', '', 'g')) p from t),
s as (select *, list_transform(p, lambda x: case when x = '' then 0 when length(x) <= 3 then 1 else greatest(1, len(regexp_extract_all(x, '[aeiouy]+'))
   - case when x like '%e' and len(regexp_extract_all(x, '[aeiouy]+')) > 1 then 1 else 0 end + case when regexp_matches(x, '[^aeiouy]le$') then 1 else 0 end) end) s from c),
r as (select doc_id, coalesce(len(w)::double / greatest(1, ns), 0) ps, coalesce(list_sum(s)::double / nullif(len(w), 0), 0) pw, coalesce(len(list_filter(s, lambda x: x >= 3))::double / nullif(len(w), 0), 0) h,
  coalesce(list_sum(list_transform(w, lambda x: length(replace(x, chr(39), ''))))::double / nullif(len(w), 0), 0) pl, coalesce(greatest(1, ns)::double / nullif(len(w), 0), 0) sn, len(list_filter(s, lambda x: x >= 3)) * 30 / greatest(1, ns)::double hm from s)
select doc_id, round(206.835::double - 1.015::double * ps - 84.6::double * pw, 4) flesch_reading_ease, round(0.39::double * ps + 11.8::double * pw - 15.59::double, 4) flesch_kincaid_grade,
 round(0.4::double * (ps + 100 * h), 4) gunning_fog, round(4.71::double * pl + 0.5::double * ps - 21.43::double + 1e-9::double, 4) automated_readability_index, round(5.88::double * pl - 29.6::double * sn - 15.8::double + 1e-9::double, 4) coleman_liau_index,
 round(1.043::double * sqrt(hm) + 3.1291::double + 1e-9::double, 4) smog_index from r""",
    "clean_text_lines": f"select doc_id, md5(c) clean_md5, length(c)::bigint clean_chars from (select doc_id, {_CLEAN} c from {_D})",
    "clean_accounting": f"""
with x as (select doc_id, coalesce(text, '') a, {_CLEAN} b from {_D}),
y as (select *, len(list_filter(string_split(a, chr(10)), lambda x: trim(x) <> ''))::bigint la, len(list_filter(string_split(b, chr(10)), lambda x: trim(x) <> ''))::bigint lb from x)
select doc_id, length(a)::bigint raw_characters, length(b)::bigint clean_characters, la raw_lines, lb clean_lines, (length(a) - length(b))::bigint removed_characters, la - lb removed_lines,
 len({_tok('a')})::bigint raw_words, len({_tok('b')})::bigint clean_words, (len({_tok('a')}) - len({_tok('b')}))::bigint removed_words from y""",
    "title_canonicalise": f"select p_partkey, {_CANON} canonical, {_MATCH} match_title, regexp_replace({_MATCH}, '\\s+', '-', 'g') slug, regexp_replace(lower({SQL_TITLE}), '[^a-z0-9]+', '', 'g') song_key from part",
    "version_flags": f"""
with t as (select p_partkey, p_size, {SQL_TITLE} t from part)
select p_partkey, {', '.join(f"regexp_matches(t, '(?i){p}') {n}" for n, p in T.VERSION_FLAGS.items())}, not ({' or '.join(f"regexp_matches(t, '(?i){p}')" for p in T.VERSION_FLAGS.values())}) is_original, p_size > 40 is_bonus from t""",
    "normalize_text": rf"select doc_id, md5({_SQL_PUNCT.replace('(text', chr(40) + 'trim(regexp_replace(lower(text), ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '))', 1)}) normal_md5, trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')) || ' Feat. X', '(?i)\bfeat(?:uring)?\.?\b.*$', '')) without_feat from {_D}",
    "surrogate_key": """select o_orderkey, printf('tr-%02d-%03d', year(o_orderdate) % 100, o_orderkey % 1000) as key, floor(o_totalprice / 10.0::double + 0.5::double) / 100.0::double as seconds,
 coalesce(nullif(trim(substring(o_orderpriority, 3, 20)), ''), 'none') as priority, year(o_orderdate)::bigint as year from orders""",
    "label_render": """select c_custkey, lower(c_mktsegment) as label, printf('balance:%+.2f | nation:%+.2f', c_acctbal, -c_nationkey::double) listed from customer""",
}
SQL["doc_feature_row"] = f"select * from ({SQL[FEATURE_TABLES[0]]}) " + " ".join(f"left join ({SQL[name]}) using (doc_id)" for name in FEATURE_TABLES[1:])
SQL["doc_feature_coverage"] = f"with r as ({SQL['doc_feature_row']}), c as (select count(columns(* exclude doc_id)) from r), n as (select count(*) n from r) select feature, documents, round(documents / n::double, 6) share from (unpivot c on * into name feature value documents), n"
QUERIES = {n: globals()[n] for n in SQL}
