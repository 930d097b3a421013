"""Exact top-k inner-product search by MaxScore.

Method: the terms are the vector components; a shard (a block of candidate rows) has for each term the least and the
largest value, hence bounds of the term's share in a query's score. Terms are ordered by how much they can add; the
largest tail whose whole gain cannot lift a row over the k-th best score so far is non-essential. The essential
postings are summed for all rows of the shard; the others are probed for the rows still competitive. Each task keeps
its k best of a query over all its shards, and the tasks' lists are merged.

Defined results: vectors that are null or hold null or non-finite components take no part, neither do rows whose key is null or no integer; shorter
vectors count as filled up with zeros, so empty ones score 0; every finite component is taken exactly, whatever its size
(shards with products beyond 2^53 are summed in whole numbers without a bound), and a score beyond 64 bits is the
nearest 64-bit number; equal scores go to the smaller id; a query with fewer than k candidates
gets all; rows that repeat an id are candidates of their own, except to the query of that id; an empty table gives an
empty table; extra columns are not read. Queries are broadcast in blocks of ``QUERY_BLOCK`` rows, as many as it takes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import arrow_map
from tessera.llm.vectors import LEAST, MOST, blocks, exact_pair, filled, finite, matrix, whole
from tessera.storage import materialize, scratch

QUERY_BLOCK = 8192
SHARD_ROWS = 4096
PROBE = 8


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    return df.select(F.col(key).try_cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & finite(F.col("v")))


class Best:
    """The k best of one query, sorted by score down and id up."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self):
        return int(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.clip(scores, LEAST, MOST).astype(np.int64)
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((-ids, scores))[::-1][: self.k]
        self.ids, self.scores = ids[order], scores[order]


def search_shard(ids: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, query: np.ndarray, own: int, best: Best) -> None:
    """``columns``: a row for each term, as long as the shard."""
    ends = query * low, query * high
    most, gain = np.maximum(*ends), np.abs(ends[1] - ends[0])
    if most.sum() < best.least:
        return
    if gain.dtype == object:  # the order decides the cost only
        order = np.argsort([-float(min(g, 10**300)) for g in gain], kind="stable")
    else:
        order = np.argsort(-gain, kind="stable")
    rest = np.concatenate((np.cumsum(most[order][::-1])[::-1], [0]))  # what the terms from here on can give at most
    tail = np.concatenate((np.cumsum(gain[order][::-1])[::-1], [0]))
    floor = most.sum() - gain.sum()
    essential = max(1, int(np.searchsorted(-tail, -(best.least - floor), side="right"))) if np.isfinite(best.least) else len(order)
    essential = min(essential, len(order))
    first = order[:essential]
    score = query[first] @ columns[first]
    at = np.flatnonzero((score + rest[essential] >= best.least) & (ids != own))
    score = score[at]
    while essential < len(order) and len(at):
        some = order[essential : essential + PROBE]
        score = score + query[some] @ columns[np.ix_(some, at)]
        essential += len(some)
        keep = score + rest[essential] >= best.least
        at, score = at[keep], score[keep]
    if len(at):
        best.offer(ids[at], score)


def top_k(df: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): for each row whose key is divisible by ``every``, its k best other rows."""
    spark = df.sparkSession
    vectors = usable(df, key, vector)
    found = []
    with scratch(spark):
        for block in blocks(materialize(vectors.where(F.col("id") % every == 0), "queries"), QUERY_BLOCK):
            ids, rows = np.array([r[0] for r in block], np.int64), [r[1] for r in block]
            asked = whole(filled(rows, max(map(len, rows))), scale)
            found.append(arrow_map(vectors, _searcher(spark.sparkContext.broadcast((ids, asked)), k, scale), "query_id long, id long, score long"))
    if not found:
        return vectors.selectExpr("id as query_id", "0 as rank", f"id as `{key}`", "0L as score").where("false")
    merged = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def _searcher(shared, k: int, scale: int):
    def run(batches):
        own, asked = shared.value
        best = [Best(k) for _ in own]
        for b in batches:
            for at in range(0, b.num_rows, SHARD_ROWS):
                part = b.slice(at, SHARD_ROWS)
                rows = whole(matrix(part.column(1), asked.shape[1]), scale)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                queries = np.zeros((len(asked), rows.shape[1]), asked.dtype)
                queries[:, : asked.shape[1]] = asked
                columns, queries = exact_pair(np.ascontiguousarray(rows.T), queries)
                low, high = (columns.min(axis=1), columns.max(axis=1)) if columns.size else (np.zeros(len(columns)),) * 2
                for q, me, top in zip(queries, own.tolist(), best, strict=True):
                    search_shard(ids, columns, low, high, q, me, top)
        size = [len(x.ids) for x in best]
        if sum(size):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, size)), pa.array(np.concatenate([x.ids for x in best])), pa.array(np.concatenate([x.scores for x in best]))], ["query_id", "id", "score"]
            )

    return run


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""
