"""Hard-negative mining over one-dimensional distance keys.

Method: a vector gets one more component so that all have the same length (the largest, M); then the rows of the highest
inner product with an anchor are the nearest to the anchor, whose own new component is 0: distance^2 = |a|^2 + M^2 - 2 a.x.
Each row is assigned to its nearest pivot and stored sorted by (pivot, distance to it), so a row is found by a
one-dimensional key. By the triangle inequality a row of key d is no nearer to an anchor at distance D from the pivot than
|d - D|. A search scans the annuli around the pivots from the anchor's own distance outwards, in runs of ``RUN`` rows of
the sorted order, the run of the least such bound first; when the bound of what remains says that its inner products
lie below the k-th best found, the result is certified. It has two stages: the home stage scans the annuli of the
anchor's nearest pivot, and its results, merged over all tasks, give every task the score to beat before the other one.

Scores are inner products of whole numbers: exact, in doubles or Python's integers. Bounds are doubles that give way by
more than they round, and a run is skipped only if its bound is below the k-th best, so ties are never lost. Pivots are
``PIVOTS`` rows of the table with the smallest hashes of their keys, refined by nothing: they decide the cost only.

A request is an anchor with windows of scores, and its label is either asked for or excluded; each window gets its k
best rows. Positives: one window without limits, same label. Negatives: a window for each positive, other labels.

Defined results: rows with a null key or label, a null vector, or a null or non-finite component take no part; keys are
integers; shorter vectors count as filled up with zeros; components of any size are taken exactly (rows of which doubles
cannot hold the square are scanned for each anchor), scores are compared exactly, and one beyond 64 bits is returned as
the nearest 64-bit number; equal scores go to the smaller key; anchors without positives give no rows; rows
that repeat a key are rows of their own, but no partners of an anchor of that key, and an anchor that repeats a key is
asked for once (the smaller label, then vector); an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import arrow_map
from tessera.llm.vectors import LEAST, MOST, blocks, column, exact_pair, filled, finite, gather, matrix, rows_at_most, whole
from tessera.storage import materialize, scratch

PIVOTS, RUN, REQUESTS = 32, 1024, 8192
#: Beyond this length a row has no key: its square could leave the doubles.
LONG = 1e140
#: Bounds give way by this share, far more than doubles round.
GIVE = 1e-9
STORED = "id long, label long, v array<double>, pivot int, d double"
#: ``exact`` is the score in an order-preserving form without limit, ``score`` the nearest 64-bit number.
FOUND = "anchor_id long, window int, id long, label long, exact binary, score long"


def sortable(score: int) -> bytes:
    """A form whose bytes sort as the numbers do: sign, length, digits; complements for those below zero."""
    digits = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    if score >= 0:
        return b"\x01" + len(digits).to_bytes(2, "big") + digits
    return b"\x00" + (0xFFFF - len(digits)).to_bytes(2, "big") + bytes(255 - b for b in digits)


def number(exact: bytes) -> int:
    return int.from_bytes(exact[3:], "big") if exact[0] else -int.from_bytes(bytes(255 - b for b in exact[3:]), "big")


def usable(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("id is not null and label is not null").where(finite(F.col("v")))


def _lengths(x: np.ndarray) -> np.ndarray:
    """Squared lengths in doubles, infinite for rows beyond LONG."""
    x = np.array([[float(n) if abs(n) < LONG else math.inf for n in r] for r in x.tolist()]).reshape(x.shape) if x.dtype == object else x
    with np.errstate(over="ignore"):
        length = (x * x).sum(axis=1)
    return np.where(length < LONG * LONG, length, math.inf)


def store(rows: DataFrame, width: int, scale: int) -> tuple[DataFrame, np.ndarray, float]:
    """(rows sorted by (pivot, distance) with both, the pivots with their new component, M^2)."""

    def measure(batches):
        for b in batches:
            n = _lengths(whole(matrix(b.column(0), width), scale))
            n = n[np.isfinite(n)]
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array([float(n.max())])], ["m"])

    top = arrow_map(rows.select("v"), measure, "m double").agg(F.max("m")).first()[0] or 0.0
    top *= 1 + GIVE
    few = [r.v for r in rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(PIVOTS).collect()]
    points = whole(filled(few, width), scale)
    points = points[np.isfinite(_lengths(points))].astype(np.float64) if len(points) else np.zeros((0, width))
    if not len(points):
        points = np.zeros((1, width))
    points = np.c_[points, np.sqrt(np.maximum(0, top - (points * points).sum(axis=1)))]

    def key(batches):
        for b in batches:
            x = whole(matrix(b.column(2), width), scale)
            length = _lengths(x)
            ok = np.isfinite(length)
            pivot, d = np.full(len(x), -1, np.int32), np.zeros(len(x))
            if ok.any():
                far = distances(np.c_[x[ok].astype(np.float64), np.sqrt(np.maximum(0, top - length[ok]))], points)
                pivot[ok] = far.argmin(axis=1)
                d[ok] = far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(d)], [*b.schema.names, "pivot", "d"])

    keyed = materialize(arrow_map(rows, key, STORED), "keyed")
    stored = keyed.repartitionByRange("pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")
    return materialize(stored, "stored"), points, top


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ points.T) + (points * points).sum(axis=1)))


class Requests:
    """A block of anchors with their windows; ``least`` has the scores to beat, by anchor and window."""

    def __init__(self, asked: list, width: int, scale: int, points: np.ndarray, top: float, share: tuple[int, int] = (0, 0)):
        self.ids, self.labels = np.array([r["id"] for r in asked], np.int64), np.array([r["label"] for r in asked], np.int64)
        self.vectors = whole(filled([r["v"] for r in asked], width), scale)
        limits = lambda p: (-math.inf, math.inf) if p is None else (-(-share[0] * number(p) // 100), share[1] * number(p) // 100)
        self.windows = [[(w["window"], *limits(w["around"] if "around" in w else None)) for w in r["windows"]] for r in asked]
        self.least = [[-math.inf if w["least"] is None else number(w["least"]) for w in r["windows"]] for r in asked]
        length = _lengths(self.vectors)
        self.open = ~np.isfinite(length)  # no bounds for these
        safe = np.where(self.open[:, None], 0.0, self.vectors).astype(np.float64)
        self.span = np.where(self.open, 0, length) + top
        self.away = distances(np.c_[safe, np.zeros(len(asked))], points)
        self.home = self.away.argmin(axis=1)


class Top:
    """The k best rows of a window so far, by score down and key up."""

    __slots__ = ("ids", "k", "labels", "least", "scores")

    def __init__(self, k: int, least):
        self.k, self.least, self.ids, self.labels, self.scores = k, least, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def offer(self, ids, labels, scores) -> None:
        ids, labels, scores = np.concatenate((self.ids, ids)), np.concatenate((self.labels, labels)), np.concatenate((self.scores, scores))
        if len(ids) > 4 * self.k and scores.dtype != object:
            few = scores >= np.partition(scores, -self.k)[-self.k]
            ids, labels, scores = ids[few], labels[few], scores[few]
        order = np.lexsort((-ids, scores))[::-1][: self.k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k], int)
        self.ids, self.labels, self.scores = ids[order], labels[order], scores[order]
        if len(ids) >= self.k and len(order) == self.k:
            self.least = max(self.least, self.scores[-1])


def runs(batches, width: int, scale: int):
    """The sorted rows in runs of one pivot: (pivot, least key, largest key, ids, labels, columns)."""
    for t in gather(batches, RUN):
        pivots, d = column(t, "pivot").to_numpy(), column(t, "d").to_numpy()
        x, ids, labels = whole(matrix(column(t, "v"), width), scale), column(t, "id").to_numpy(), column(t, "label").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(pivots)) + 1).tolist(), len(pivots)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(pivots[a]), float(d[a:b].min()), float(d[a:b].max()), ids[a:b], labels[a:b], np.ascontiguousarray(x[a:b].T)


def scan(held: list, r: Requests, tops: list[list[Top]], same: bool, home: bool | None) -> int:
    """Searches the held runs for each anchor, the least bound first; returns how many rows were scored.

    ``home``: True for the runs of the anchor's nearest pivot only, False for the others only.
    """
    pivots = np.array([h[0] for h in held])
    low, high = np.array([h[1] for h in held]), np.array([h[2] for h in held])
    scored = 0
    for q in range(len(r.ids)):
        own = (pivots == r.home[q]) & ~r.open[q]
        at = np.flatnonzero(own if home else ~own if home is not None else np.ones(len(held), bool))
        if not len(at):
            continue
        away = r.away[q][pivots[at]]
        bound = np.maximum(0, np.maximum(low[at] - away, away - high[at]) - GIVE * (away + high[at]))
        most = (r.span[q] - bound * bound) / 2 + GIVE * r.span[q]
        most[(pivots[at] < 0) | r.open[q]] = math.inf  # rows or anchors without a key
        for i in np.argsort(-most, kind="stable"):
            bar = float(most[i])  # Python compares it with integers of any size
            wanted = [w for w, (_, least, _) in enumerate(r.windows[q]) if bar >= max(least, tops[q][w].least)]
            if not wanted:
                break  # what remains has lower bounds still: certified
            _, _, _, ids, labels, columns = held[at[i]]
            ok = np.flatnonzero(((labels == r.labels[q]) == same) & (ids != r.ids[q]))
            if not len(ok):
                continue
            columns, query = exact_pair(columns, r.vectors[q : q + 1])
            scores = (query[0] @ columns)[ok]
            scored += len(ok)
            for w in wanted:
                _, least, greatest = r.windows[q][w]
                got = ok_scores(scores, max(least, tops[q][w].least), greatest)
                if len(got):
                    tops[q][w].offer(ids[ok[got]], labels[ok[got]], scores[got])
    return scored


def ok_scores(scores: np.ndarray, least, greatest) -> np.ndarray:
    return np.flatnonzero((scores >= least) & (scores <= greatest)) if len(scores) else np.empty(0, int)


def _searcher(shared, k: int, same: bool, home: bool | None, width: int, scale: int):
    def run(batches):
        r = shared.value
        tops = [[Top(k, least) for least in row] for row in r.least]
        held, used = [], 0
        for x in runs(batches, width, scale):
            held.append(x)
            used += x[5].size
            if used * 8 > 64 << 20:
                scan(held, r, tops, same, home)
                held, used = [], 0
        if held:
            scan(held, r, tops, same, home)
        for q, row in enumerate(tops):
            out = [(int(r.ids[q]), r.windows[q][w][0], i, l, sortable(int(n)), max(LEAST, min(MOST, int(n)))) for w, t in enumerate(row) for i, l, n in zip(t.ids.tolist(), t.labels.tolist(), t.scores.tolist(), strict=True)]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor_id", "window", "id", "label", "exact", "score"])

    return run


def best_in_windows(stored: DataFrame, requests: DataFrame, points: np.ndarray, top: float, width: int, scale: int, k: int, same: bool, share: tuple[int, int] = (0, 0)) -> DataFrame:
    """(anchor_id, window, rank, id, exact, score): each window's k best rows, certified, as a written table.

    ``requests``: id, label, v, windows (array of window, around), one row an anchor. A window holds the scores of
    ``share`` hundredths of the number ``around`` (sortable), or all if that is null.
    """
    spark, found = stored.sparkSession, []

    def ask(table: DataFrame, home: bool | None) -> list[DataFrame]:
        out = []
        for block in blocks(table, rows_at_most(width, REQUESTS)):
            shared = spark.sparkContext.broadcast(Requests(block, width, scale, points, top, share))
            out.append(arrow_map(stored, _searcher(shared, k, same, home, width, scale), FOUND))
        return out

    w = Window.partitionBy("anchor_id", "window").orderBy(F.desc("exact"), "id")
    best = lambda parts: reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    first = requests.withColumn("windows", F.transform("windows", lambda x: x.withField("least", F.lit(None).cast("binary"))))
    if not (parts := ask(first, True)):
        return spark.createDataFrame([], f"{FOUND}, rank int")
    found = materialize(best(parts), "home")
    beat = found.where(F.col("rank") == k).groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("window", "exact"))).alias("beat"))
    second = requests.join(beat, "id", "left").withColumn("windows", F.transform("windows", lambda x: x.withField("least", F.try_element_at("beat", x["window"])))).drop("beat")
    rest = ask(materialize(second, "requests"), False)
    return materialize(best([found.drop("rank"), *rest]), "best")


def mine(df: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose key is divisible by
    ``every`` and each of its first positives, the first negatives with low * positive <= 100 * negative <= high * positive."""
    spark = df.sparkSession
    with scratch(spark):
        rows = materialize(usable(df, key, vector, label), "rows")
        width = rows.agg(F.max(F.size("v"))).first()[0] or 0
        stored, points, top = store(rows, width, scale)
        anchors = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
        window = "struct<window:int,around:binary>"
        asked = materialize(anchors.withColumn("windows", F.array(F.struct(F.lit(0).alias("window"), F.lit(None).alias("around")).cast(window))), "anchors")
        found = best_in_windows(stored, asked, points, top, width, scale, positives, True).select("anchor_id", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("exact").alias("around"), F.col("score").alias("positive_score"))
        windows = found.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("window", "around").cast(window))).alias("windows"))
        again = materialize(anchors.join(windows, "id"), "anchors")
        lost = best_in_windows(stored, again, points, top, width, scale, negatives, False, (low, high))
        joined = lost.join(found.drop("around"), ["anchor_id", "window"])
        out = joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return materialize(out, "negatives", keep=True)


def label_of(key: str = "vec_id", label: str = "label") -> Column:
    """The contract's labels: those of keys divisible by 7 are moved on by one."""
    return F.when(F.col(key) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))


SQL = """
with r as (select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
           where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id anchor_id, b.id, a.label = b.label same, list_inner_product(a.v, b.v)::bigint score from r a join r b on a.id <> b.id where a.id % 100 = 0),
p as (select anchor_id, id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select anchor_id, positive_id, positive_score, s.id negative_id, s.score negative_score, row_number() over (partition by anchor_id, positive_id order by s.score desc, s.id) rank
      from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::int rank, negative_id, positive_score, negative_score from n where rank <= 10"""
