"""Text functions as column expressions: all stay in the JVM, and none needs a shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Patterns of tokens, sentences, versions, section words and credit lines.
WORD = r"(?U)\b[a-z]+(?:'[a-z]+)?\b"
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
VERSION_WORDS = "live|remaster(?:ed)?|demo|remix|instrumental|acoustic|radio edit|album version"
VERSION_FLAGS = {
    "is_live": r"\blive\b", "is_remaster": r"\bremaster(?:ed)?\b", "is_demo": r"\bdemo\b",
    "is_remix": r"\bremix\b|\breanimation\b", "is_instrumental": r"\binstrumental\b", "is_acoustic": r"\bacoustic\b",
}
SECTION_WORDS = r"intro|verse|pre[- ]?chorus|chorus|hook|refrain|bridge|outro|interlude|instrumental|breakdown|spoken|rap|post[- ]?chorus|repeat|solo|sample"
CREDITS = r"^\s*(?:lyrics?|written by|produced by|translation|contributors?)\s*[:\-]"
PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", " ": " "}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """white space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def canonical_title(c: Column | str) -> Column:
    """a trailing bracketed or dashed version marker is dropped."""
    t = F.regexp_replace(collapse(c), rf"(?i)\s*[\(\[][^)\]]*\b(?:{VERSION_WORDS})\b[^)\]]*[\)\]]\s*$", "")
    return collapse(F.regexp_replace(t, rf"(?i)\s+[-–—]\s+.*\b(?:{VERSION_WORDS})\b.*$", ""))


def match_title(c: Column | str) -> Column:
    """F1: canonical title, lower case, ``&`` spelled out, punctuation and underscores as spaces."""
    t = F.replace(F.lower(canonical_title(c)), F.lit("&"), F.lit(" and "))
    return collapse(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", " "))


def version_flags(c: Column | str) -> dict[str, Column]:
    """one flag a version word; null is false. ``is_original``: none is set."""
    flags = {n: F.coalesce(col(c).rlike(f"(?i){p}"), F.lit(False)) for n, p in VERSION_FLAGS.items()}
    none = ~F.greatest(*(f.cast("int") for f in flags.values())).cast("boolean")
    return flags | {"is_original": none}


def drop_featuring(c: Column | str) -> Column:
    """F4."""
    return F.trim(F.regexp_replace(col(c), r"(?i)\bfeat(?:uring)?\.?\b.*$", ""))


def slug(c: Column | str, default: str = "item") -> Column:
    """F5."""
    s = F.regexp_replace(match_title(c), r"\s+", "-")
    return F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s)


def song_key(c: Column | str) -> Column:
    """F6."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")


def compatible(c: Column | str) -> Column:
    """Unicode's compatibility composition (NFKC), by the library that Spark brings for its collations; plain ASCII is left as it is."""
    c = col(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))).otherwise(c)


def plain_punctuation(c: Column | str) -> Column:
    """Typographic quotes, dashes, ellipses and hard spaces in ASCII, after compatibility composition."""
    c = compatible(c)
    for old, new in PUNCTUATION.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def clean_lines(c: Column | str) -> Column:
    """Time stamps, section headers and credit lines go; blanks collapse; null becomes empty."""
    t = F.replace(F.replace(plain_punctuation(F.coalesce(col(c), F.lit(""))), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*\[\d{1,2}:\d{2}(?:\.\d{1,3})?\]\s*", ""), "[ \t]+", " ")))
    header = lambda x: x.rlike(r"^[\[\(\{].{0,80}[\]\)\}]$") & x.rlike(rf"(?i)\b(?:{SECTION_WORDS})\b")
    kept = F.filter(lines, lambda x: (x == "") | ~(header(x) | x.rlike(f"(?i){CREDITS}")))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def tokens(c: Column | str) -> Column:
    """Lower-case ASCII words with at most one apostrophe part."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORD), F.lit(0))


def sentences(c: Column | str) -> Column:
    """N5."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), SENTENCE_END), F.trim), lambda x: x != "")


def lines(c: Column | str) -> Column:
    """Trimmed lines that hold something; breaks as Python's splitlines has them."""
    cut = F.split(F.coalesce(col(c), F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def run_starts(ordered: Column, least: int = 1, most: int | None = None) -> Column:
    """From a sorted array: one element for each value that occurs ``least`` to ``most`` times."""
    n = F.size(ordered)
    at = lambda i: F.try_element_at(ordered, i + 1)

    def keep(x: Column, i: Column) -> Column:
        ok = (i == 0) | (at(i - 1) != x)
        if least > 1:
            ok = ok & (i + least - 1 < n) & F.coalesce(at(i + least - 1) == x, F.lit(False))
        if most is not None:
            ok = ok & ((i + most >= n) | F.coalesce(at(i + most) != x, F.lit(True)))
        return ok

    # Index 0 of try_element_at is an error, so the first position never looks back.
    return F.filter(ordered, lambda x, i: keep(x, i)) if least > 1 or most is not None else F.array_distinct(ordered)


def ratio(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def lexical(words: Column | str) -> dict[str, Column]:
    """N7 over a token array."""
    w = col(words)
    n, v = F.size(w), F.size(F.array_distinct(w))
    size = F.transform(w, F.length)
    mean = ratio(F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x), n)
    square = ratio(F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x * x), n)  # no lambda may hold the mean: it would be computed for each word
    long = lambda k: F.size(F.filter(w, lambda x: F.length(x) >= k))
    return lexical_of(n, v, mean, square, long(4), long(7), long(10))


def lexical_of(n: Column, v: Column, mean: Column, square: Column, over_3: Column, over_6: Column, over_9: Column) -> dict[str, Column]:
    """N7 from the counts alone."""
    return {
        "word_count": n, "unique_word_count": v, "type_token_ratio": ratio(v, n),
        "root_type_token_ratio": ratio(v, F.sqrt(n.cast("double"))), "corrected_type_token_ratio": ratio(v, F.sqrt(2.0 * n)),
        "repeated_word_occurrences": n - v, "token_repetition_ratio": ratio(n - v, n), "mean_word_length": mean, "std_word_length": F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)),
        "long_word_count": over_6, "long_word_ratio": ratio(over_6, n), "very_long_word_count": over_9, "very_long_word_ratio": ratio(over_9, n),
        "lexical_density_proxy": ratio(over_3, n),
    }


def spread(counts: Column | str) -> tuple[Column, Column]:
    """Mean and population standard deviation of an array of whole numbers; 0 of an empty one."""
    c = col(counts)
    total = lambda f: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + f(x))
    mean, square = ratio(total(lambda x: x), F.size(c)), ratio(total(lambda x: x * x), F.size(c))
    return mean, F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))


def count_of(c: Column | str, sign: str) -> Column:
    """How often a literal stands in a text."""
    return (F.length(col(c)) - F.length(F.replace(col(c), F.lit(sign), F.lit("")))) / F.lit(len(sign))


def syllables(word: Column) -> Column:
    """N12 for one lower-case word."""
    w = F.regexp_replace(word, "[^a-z]", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = F.when(w.endswith("e") & (groups > 1), 1).otherwise(0)
    ending = F.when(w.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), groups - silent + ending))


def readability(words: Column | str, n_sentences: Column) -> dict[str, Column]:
    """N13 over a token array."""
    s = F.transform(col(words), syllables)
    letters = F.aggregate(col(words), F.lit(0).cast("long"), lambda a, x: a + F.length(F.replace(x, F.lit("'"), F.lit(""))))
    return readability_of(F.size(col(words)), F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x), F.size(F.filter(s, lambda x: x >= 3)), letters, n_sentences)


def readability_of(n: Column, syllables: Column, many: Column, letters: Column, n_sentences: Column) -> dict[str, Column]:
    """N13 from the counts alone, rounded to 4 places."""
    per_sentence = ratio(n, F.greatest(F.lit(1), n_sentences))
    per_word = ratio(syllables, n)
    hard = ratio(many, n)
    per_letter, full = ratio(letters, n), F.greatest(F.lit(1), n_sentences)
    return {
        "flesch_reading_ease": F.round(206.835 - 1.015 * per_sentence - 84.6 * per_word, 4),
        "flesch_kincaid_grade": F.round(0.39 * per_sentence + 11.8 * per_word - 15.59, 4),
        "gunning_fog": F.round(0.4 * (per_sentence + 100 * hard), 4),
        "automated_readability_index": F.round(4.71 * per_letter + 0.5 * per_sentence - 21.43 + 1e-9, 4),
        "coleman_liau_index": F.round(5.88 * per_letter - 29.6 * ratio(full, n) - 15.8 + 1e-9, 4),
        "smog_index": F.round(1.043 * F.sqrt(ratio(many * 30, full)) + 3.1291 + 1e-9, 4),
    }


def lexicon_count(words: Column | str, members: Iterable[str]) -> Column:
    """Tokens that the list holds."""
    found = F.array(*(F.lit(x) for x in members))
    return F.size(F.filter(col(words), lambda x: F.array_contains(found, x)))


def pretty_label(c: Column | str, prefix: str = "", suffix: str = "") -> Column:
    """F13."""
    return F.trim(F.replace(F.regexp_replace(col(c), f"^{prefix}|{suffix}$", ""), F.lit("_"), F.lit(" ")))


def signed_list(pairs: Column | str, places: int = 3, between: str = " | ") -> Column:
    """``name:+0.123`` of an array<struct<name,value>>."""
    return F.array_join(F.transform(col(pairs), lambda p: F.format_string(f"%s:%+.{places}f", p["name"], p["value"])), between)
