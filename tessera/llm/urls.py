"""URL filter: rules by host and path, else a logistic regression on hashed character n-grams of host and path.

Method: n-grams of ``^host$`` (3 to 5 letters) and of ``^path$`` (3 and 4) fall into ``BUCKETS`` buckets; the model is
trained on a small labelled table of URLs by full-batch gradient descent on the driver (its rows are bounded); a URL's
score is the sum of the weights of its distinct buckets. All is DataFrame functions: no Python runs on the executors.

Defined results: a null URL or one without ``://`` has empty host, path and rule, and the model's verdict on empty
text; any length is judged whole; repeated rows each give their row; empty tables give empty tables; extra columns of
the input are dropped from the result, so that none can clash. Ties between rules of one length go to the smaller text.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 4096
#: Rows of the labelled table that training takes at most.
TRAIN_ROWS = 2000
#: Rules up to this many are checked in one expression; more are joined by host suffix.
RULES_INLINE = 256
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

# The small labelled URL table. Common words of hosts that filter lists block, and ordinary ones; no host
# of any test table stands here.
BLOCKED_WORDS = "spam spammer spamhost pills pillshop cheap cheap-meds cheap-loans meds viagra pharma casino casinos casino-royal online-casino poker slots roulette jackpot win win-prizes winner bet bets bet-now betting bets-live sportsbet free free-movies free-download free-gifts freebies adult adults adult-cams adult-video porn xxx sex sex-cams escort ads ads-server adserver ad-clicks adtech track tracker tracking clicktrack popads popunder warez cracks torrent keygen malware phishing payday payday-loans quick-cash link-farm content-farm clickfarm seo-links click-bait replica-watches get-rich miracle-diet".split()
ALLOWED_WORDS = "news newspaper weather library museum university school science journal wiki docs help support developer forum garden recipes cooking travel maps history music books reading research health hospital doctor city council parliament court bank station theatre festival football running cycling photo camera nature forest river mountain ocean animals other mother father brother weathering there therefore thermal thesis thin thing think thinking third thirty this thistle thorn thought thread three threshold through throne thunder together tether gathering northern southern leather feather ether rather motion nation notion potion question section station tradition education information communication mention attention fiction direction selection able table stable fable noble cable double trouble visible possible shore short shine sheet when where which white whale western eastern leading reading meeting evening morning eau menteur maison jardin ville musique ecole ciudad queso lichkeit server ungewohnt sprache garten schule stadt musik bibliotek camino montana noticias escuela universidad".split()
ALLOWED_FRONT, SUFFIXES = ("", "www.", "blog.", "m."), ("com", "net", "org")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): each word once on each suffix, fronts taken in turn for both kinds alike."""
    rows = []
    for words, blocked in ((BLOCKED_WORDS, 1), (ALLOWED_WORDS, 0)):
        for i, w in enumerate(words):
            for j, suffix in enumerate(SUFFIXES):
                front = ALLOWED_FRONT[(i + j) % 4]
                rows.append(f"('https://{front}{w}{'' if j == 1 else '-' + words[i - 7]}.example.{suffix}/{('en', 'fr', 'de', 'es')[i % 4]}/{i * 37 + j}', {blocked})")
    rows += ["('', 0)", "('no-address', 0)", "(null, 0)"]
    return spark.sql(f"select col1 as url, col2 as blocked from values {', '.join(rows)}")


def parts(df: DataFrame, url: str) -> DataFrame:
    rest = F.when(F.locate("://", F.col(url)) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    return (
        df.withColumn("_rest", rest).withColumn("_host", host)
        .withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), "^[^?#]*", 0))
        .withColumn("host", F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).drop("_rest", "_host")
    )


def buckets(host: str = "host", path: str = "path") -> Column:
    """The distinct buckets of the n-grams; a part of fewer letters than n has none of that length."""

    def grams(text: str, n: int, tag: str) -> str:
        marked = f"concat('^', {text}, '$')"
        marked = marked if tag == "h" else f"regexp_replace({marked}, '[0-9]', '0')"  # numbers say nothing
        return f"transform(sequence(1, greatest(1, length({marked}) - {n - 1})), i -> pmod(xxhash64('{tag}', substring({marked}, i, {n})), {BUCKETS}))"

    each = [*(grams(host, n, "h") for n in (3, 4, 5)), *(grams(path, n, "p") for n in (3, 4))]
    return F.expr(f"array_distinct(concat({', '.join(each)}))")


def train(labelled: DataFrame, url: str = "url", label: str = "blocked", rounds: int = 400, rate: float = 1.0, decay: float = 0.002) -> list[float]:
    """Weights by bucket, and last the bias. The small table's buckets come to the driver once: at most ``TRAIN_ROWS`` rows."""
    rows = [(r[0], float(r[1])) for r in parts(labelled, url).select(buckets(), label).limit(TRAIN_ROWS).collect()]
    w, bias = defaultdict(float), 0.0
    for _ in range(rounds):
        slope: dict[int, float] = defaultdict(float)
        off = 0.0
        for x, y in rows:
            p = 1 / (1 + math.exp(-(bias + sum(w[i] for i in x) / math.sqrt(len(x)))))
            for i in x:
                slope[i] += (p - y) / math.sqrt(len(x))
            off += p - y
        for i, g in slope.items():
            w[i] -= rate * (8 * g / len(rows) + decay * w[i])
        bias -= rate * off / len(rows)
    return [*(w[i] for i in range(BUCKETS)), bias]


def judge(df: DataFrame, weights: list[float], rules: list[tuple[str, str]] = RULES, url: str = "url", key: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row."""
    spark = df.sparkSession
    seen = parts(df.select(key, F.col(url).alias("_url")), "_url").drop("_url")
    table = F.lit([float(f"{x:.9g}") for x in weights[:-1]])
    total = F.aggregate(F.transform(F.col("_b"), lambda i: F.element_at(F.col("_w"), (i + 1).cast("int"))), F.lit(0.0), lambda a, b: a + b)
    # One row of weights (32 KB whatever the data) travels with the plan as a literal.
    scored = seen.withColumn("_b", buckets()).withColumn("_w", table)
    scored = scored.withColumn("score", 1 / (1 + F.exp(-(total / F.sqrt(F.size("_b")) + weights[-1])))).drop("_b", "_w")
    if len(rules) <= RULES_INLINE:
        split = [(r, r[: r.index("/")], r[r.index("/") :], v) for r, v in sorted(rules, key=lambda x: (-len(x[0]), x[0]))]
        fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p, _ in split]
        rule = F.coalesce(F.lit(None).cast("string"), *(F.when(f, F.lit(r)) for f, (r, *_) in zip(fits, split, strict=True)))
        said = F.coalesce(F.lit(None).cast("string"), *(F.when(F.col("rule") == r, F.lit(v)) for r, _, _, v in split))
        out = scored.withColumn("rule", rule).withColumn("_said", said)
    else:
        listed = spark.createDataFrame(rules, "rule string, said string")
        listed = listed.select("rule", "said", F.expr("substring(rule, 1, locate('/', rule) - 1)").alias("suffix"), F.expr("substring(rule, locate('/', rule))").alias("front"))
        tails = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
        by_place = scored.select("host", "path").distinct()
        hit = (
            by_place.withColumn("suffix", F.explode(tails)).join(listed, "suffix").where(F.col("path").startswith(F.col("front")))
            .groupBy("host", "path").agg(F.min(F.struct(-F.length("rule"), "rule", "said")).alias("b"))
            .select("host", "path", F.col("b.rule").alias("rule"), F.col("b.said").alias("_said"))
        )
        out = scored.join(hit, ["host", "path"], "left")
    verdict = F.coalesce(F.col("_said"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))
