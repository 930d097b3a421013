"""Vector code compression: product codes whose codebooks are refined by Heap Lloyd.

Method: components become floor(scale * x); vectors are cut into ``parts`` equal parts, each position with a codebook of
its own. Blocks of vectors are rows of a written table that also holds, for each position and entry, a heap of the parts
that the entry holds, keyed by slack: lower bound of the distance to the second nearest entry minus upper bound of the
distance to its own. A part keeps its entry as long as its slack exceeds what entries have drifted since it was pushed:
the own entry's way plus the longest way of another, summed over the rounds. So a key is stored as slack plus the sum so
far, and a round pops only the parts whose key the entry's sum has reached, measures those exactly against all entries
and pushes them back. A round adds the moved parts' components to the sums (one row a slot and block, summed by Spark);
the driver holds the codebooks and sums only, ``entries`` * width numbers.

Bounds are doubles, made smaller by more than their rounding error, so a part that might move is always measured; what is
measured is measured in whole numbers (Python's integers where doubles are not exact). Hence the result is Lloyd's own.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; a null key stays and comes
after all others where the smallest keys are chosen (repeated keys: the smaller vector first); shorter vectors count as
filled up with zeros to the longest one's length, rounded up to a multiple of ``parts``; fewer rows than ``entries`` give
as many entries as rows; components of any size are taken exactly; an error beyond 64 bits is the largest 64-bit number;
an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tessera.llm.common import arrow_map
from tessera.llm.vectors import EXACT, MOST, column, finite, gather, integers, largest, matrix, whole
from tessera.storage import broadcast_if_small, materialize, scratch

BLOCK = 4096
#: Bounds give way by this share, far more than doubles round.
GIVE = 1e-12
#: Sums travel as limbs of so many bits, so that longs hold them whatever the components' size.
LIMB = 30
#: Labels that a broadcast may hold; more are joined by a shuffle.
LABELS = 100_000


def _pack(v: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest form that holds them."""
    if v.dtype == object:
        return "json", json.dumps(v.tolist()).encode()
    most = largest(v)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, v.astype(kind).tobytes()


def _unpack(kind: str, data: bytes, rows: int) -> np.ndarray:
    if kind == "json":
        return np.array(json.loads(data), object).reshape(rows, -1)
    return np.frombuffer(data, kind).astype(np.float64).reshape(rows, -1)


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry, exactly."""
    if x.dtype != object and book.dtype != object and x.shape[1] * (largest(x) + largest(book)) ** 2 < EXACT:
        return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    x, book = integers(x), integers(book)
    return np.array([[sum((a - b) ** 2 for a, b in zip(r, c, strict=True)) for c in book.tolist()] for r in x.tolist()], object).reshape(len(x), len(book))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, slack) of each row; equal distances go to the lower entry."""
    d = _squares(x, book)
    own = np.argmin(d, axis=1)
    if d.dtype == object:
        return own, np.full(len(x), -np.inf)  # no bound in doubles: measured again each round
    first = np.sqrt(d[np.arange(len(x)), own])
    d[np.arange(len(x)), own] = np.inf
    second = np.sqrt(d.min(axis=1))
    return own, second * (1 - GIVE) - first * (1 + GIVE)


class Heaps:
    """The heaps of one position of a block: lists where touched, else slices of the stored arrays."""

    def __init__(self, entries: int, keys=None, rows=None, ends=None):
        self.stored = None if keys is None else [(keys[a:b], rows[a:b]) for a, b in pairwise(ends.tolist())]
        self.lists: dict[int, list] = {} if self.stored else {e: [] for e in range(entries)}
        self.entries = entries

    def _list(self, e: int) -> list:
        if e not in self.lists:
            keys, rows = self.stored[e]
            self.lists[e] = list(zip(keys.tolist(), rows.tolist(), strict=True))  # stored in heap order
        return self.lists[e]

    def pop(self, e: int, reached: float) -> list[int]:
        """The rows whose key is ``reached`` or less."""
        if e not in self.lists and not (len(self.stored[e][0]) and self.stored[e][0][0] <= reached):
            return []
        heap, out = self._list(e), []
        while heap and heap[0][0] <= reached:
            out.append(heapq.heappop(heap)[1])
        return out

    def push(self, e: int, items: list[tuple[float, int]]) -> None:
        heap = self._list(e)
        if len(items) > len(heap):
            heap += items
            heapq.heapify(heap)
        else:
            for x in items:
                heapq.heappush(heap, x)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = []
        for e in range(self.entries):
            if e in self.lists:
                keys, rows = zip(*self.lists[e], strict=True) if self.lists[e] else ((), ())
                each.append((np.array(keys, np.float64), np.array(rows, np.int32)))
            else:
                each.append(self.stored[e])
        ends = np.cumsum([0] + [len(k) for k, _ in each]).astype(np.int32)
        return np.concatenate([k for k, _ in each]), np.concatenate([r for _, r in each]), ends


def advance(x: np.ndarray, books: list[np.ndarray], drift: np.ndarray, own: np.ndarray | None, heaps: list[Heaps]) -> tuple[np.ndarray, int, dict[tuple[int, int], list]]:
    """One assignment of a block's parts: (entries by position, parts measured, changes of the entries' sums and counts).

    ``own`` is None in the first round; ``drift`` has each entry's way so far, with the longest way of another.
    """
    width, first = books[0].shape[1], own is None
    own = np.zeros((len(books), len(x)), np.uint8) if first else own.copy()
    measured, change = 0, {}
    for p, book in enumerate(books):
        part = x[:, p * width : (p + 1) * width]
        rows = np.arange(len(x)) if first else np.array([r for e in range(len(book)) for r in heaps[p].pop(e, drift[p, e] * (1 + GIVE))], np.int64)
        if not len(rows):
            continue
        measured += len(rows)
        part, old = part[rows], own[p, rows]
        new, slack = nearest(part, book)
        own[p, rows] = new
        keys = slack + drift[p, new]
        for e in np.unique(new).tolist():
            at = new == e
            heaps[p].push(e, list(zip(keys[at].tolist(), rows[at].tolist(), strict=True)))
        for e in range(len(book)):
            come, gone = new == e, np.zeros(len(rows), bool) if first else old == e
            come, gone = come & ~gone, gone & ~come
            if come.any() or gone.any():
                sums = _total(part[come]) - _total(part[gone])
                change[p, e] = [*sums.tolist(), int(come.sum()) - int(gone.sum())]
    return own, measured, change


def _total(rows: np.ndarray) -> np.ndarray:
    if rows.dtype != object and largest(rows) * len(rows) >= EXACT:
        rows = integers(rows)
    return rows.sum(axis=0) if len(rows) else np.zeros(rows.shape[1], rows.dtype)


def limbs(n: int) -> list[int]:
    """Signed digits of base 2**LIMB, the lowest first; one for all numbers of usual size."""
    if abs(n) < 1 << LIMB + 10:
        return [n]
    out, sign, n = [], 1 if n > 0 else -1, abs(n)
    while n:
        out.append(sign * (n & (1 << LIMB) - 1))
        n >>= LIMB
    return out


STATE = [
    StructField("kind", StringType()), StructField("components", BinaryType()), StructField("own", BinaryType()), StructField("keys", BinaryType()),
    StructField("rows", BinaryType()), StructField("ends", BinaryType()), StructField("measured", LongType()),
    StructField("change", ArrayType(StructType([StructField("slot", LongType()), StructField("limb", LongType()), StructField("s", LongType())]))),
]


def _state(x, books, drift, own, heaps) -> dict:
    own, measured, change = advance(x, books, drift, own, heaps)
    keys, rows, ends = zip(*(h.arrays() for h in heaps), strict=True)
    width = books[0].shape[1]
    slots = []
    for (p, e), sums in change.items():
        for k, n in enumerate(sums):
            slots += [{"slot": (p * len(books[0]) + e) * (width + 1) + k, "limb": i, "s": s} for i, s in enumerate(limbs(int(n))) if s]
    return {"own": own.tobytes(), "keys": np.concatenate(keys).tobytes(), "rows": np.concatenate(rows).tobytes(), "ends": np.concatenate(ends).tobytes(), "measured": measured, "change": slots}


def _open(row: dict, parts: int, entries: int) -> tuple[np.ndarray, np.ndarray, list[Heaps]]:
    own = np.frombuffer(row["own"], np.uint8).reshape(parts, -1)
    n = own.shape[1]
    keys, rows = np.frombuffer(row["keys"], np.float64).reshape(parts, n), np.frombuffer(row["rows"], np.int32).reshape(parts, n)
    ends = np.frombuffer(row["ends"], np.int32).reshape(parts, entries + 1)
    return _unpack(row["kind"], row["components"], n), own, [Heaps(entries, *x) for x in zip(keys, rows, ends, strict=True)]


def _begin(books, drift, scale: int, width: int, schema: pa.Schema):
    def run(batches):
        for t in gather(batches, BLOCK):
            x = whole(matrix(column(t, "v"), width), scale)
            kind, data = _pack(x)
            row = {"ids": column(t, "id").to_pylist(), "labels": column(t, "label").to_pylist(), "kind": kind, "components": data}
            yield pa.RecordBatch.from_pylist([row | _state(x, books, drift, None, [Heaps(len(books[0])) for _ in books])], schema)

    return run


def _again(books, drift, schema: pa.Schema):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                x, own, heaps = _open(row, len(books), len(books[0]))
                yield pa.RecordBatch.from_pylist([row | _state(x, books, drift, own, heaps)], schema)

    return run


def _codes(books, schema: pa.Schema):
    def run(batches):
        width = books[0].shape[1]
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                x, own, _ = _open(row, len(books), len(books[0]))
                total = [0] * len(x)
                for p, book in enumerate(books):
                    part, mine = x[:, p * width : (p + 1) * width], book[own[p]]
                    if part.dtype == object or mine.dtype == object or len(books) * width * (largest(part) + largest(mine)) ** 2 >= EXACT:
                        part, mine = integers(part), integers(mine)
                    total = ((part - mine) ** 2).sum(axis=1) + total
                codes = [bytes(c).hex() for c in own.T]
                error = [min(int(n), MOST) for n in total]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], schema.field(0).type), pa.array(row["labels"], schema.field(1).type), pa.array(codes), pa.array(error, pa.int64())], schema.names)

    return run


def _book(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.array(rows, object).reshape(len(rows), width)
    return out.astype(np.float64) if largest(out) < EXACT else out


def _way(old: list[int], new: list[int]) -> float:
    far = sum((a - b) ** 2 for a, b in zip(old, new, strict=True))
    return math.sqrt(far) * (1 + GIVE) if far < 2**1000 else math.inf


def learn(df: DataFrame, key: str, vector: str, label: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, measured: list[int] | None = None):
    """(state table, books as integers by part and entry): ``rounds`` of Lloyd and a last assignment.

    ``measured`` gets the number of parts measured by each assignment. Call it inside ``scratch``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where(finite(F.col("v")))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None, []
    part = max(1, -(-longest // parts))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    seeds = [[int(n) for n in whole(np.array([[*r.v, *[0.0] * (parts * part - len(r.v))]]), scale)[0]] for r in first]
    centres = [[s[p * part : (p + 1) * part] for s in seeds] for p in range(parts)]
    sums = [[[0] * (part + 1) for _ in seeds] for _ in range(parts)]
    drift = np.zeros((parts, len(seeds)))
    schema = StructType([StructField("ids", ArrayType(kept.schema["id"].dataType)), StructField("labels", ArrayType(kept.schema["label"].dataType)), *STATE])
    arrow, state = to_arrow_schema(schema), None
    for step in range(rounds + 1):
        books = [_book(c, part) for c in centres]
        made = arrow_map(kept, _begin(books, drift, scale, parts * part, arrow), schema) if state is None else arrow_map(state, _again(books, drift, arrow), schema)
        state = materialize(made, "codes")
        if measured is not None:
            measured.append(state.agg(F.sum("measured")).first()[0])
        if step == rounds:
            break
        for slot, limb, s in state.select(F.explode("change").alias("c")).select("c.*").groupBy("slot", "limb").agg(F.sum("s")).collect():
            at, k = divmod(slot, part + 1)
            sums[at // len(seeds)][at % len(seeds)][k] += s << LIMB * limb
        for p in range(parts):
            new = [[n // total[part] for n in total[:part]] if total[part] else old for old, total in zip(centres[p], sums[p], strict=True)]
            ways = [_way(*x) for x in zip(centres[p], new, strict=True)]
            drift[p] += [w + max(ways[:e] + ways[e + 1 :], default=0.0) for e, w in enumerate(ways)]
            centres[p] = new
    return state, centres


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", measured: list[int] | None = None, **options) -> tuple[DataFrame, list]:
    """((id, label, code, error), books): each kept row's code and squared error, as a written table."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([StructField("id", df.schema[key].dataType), StructField("label", df.schema[label].dataType), StructField("code", StringType()), StructField("error", LongType())])
    with scratch(df.sparkSession):
        state, centres = learn(df, key, vector, label, measured=measured, **options)
        if state is None:
            return df.sparkSession.createDataFrame([], schema), centres
        books = [_book(c, len(c[0])) for c in centres]
        return materialize(arrow_map(state, _codes(books, to_arrow_schema(schema)), schema), "codes", keep=True), centres


def decode(codes: DataFrame, centres: list, code: str = "code", scale: int = 4096) -> DataFrame:
    """Adds ``approximate``: the vector of the entries' components that a code stands for, each at the middle of its step."""
    table = F.array(*(F.array(*(F.lit([(n + 0.5) / scale for n in e]) for e in book)) for book in centres))
    digits = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximate", F.concat(*(F.get(F.get(table, p), digits(p)) for p in range(len(centres)))))


def report(df: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256)."""
    codes, centres = compress(df, key)
    digest = hashlib.sha256(",".join(str(n) for book in centres for entry in book for n in entry).encode()).hexdigest()
    most = F.lit(MOST).cast("decimal(38,0)")
    total = codes.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    joined = codes.join(broadcast_if_small(total, LABELS), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same by plain Lloyd in DuckDB: every round measures every part against every entry."""
    text = [
        f"with kept as (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) v, len(embedding) // {parts} w from embeddings"
        " where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"part as (select vec_id, label, p.p, v[p.p * w + 1 : (p.p + 1) * w] x, w from kept, (select unnest(range({parts})) p) p)",
        f"book0 as (select p, (row_number() over (partition by p order by vec_id) - 1) e, x c from part where vec_id in (select vec_id from kept order by vec_id limit {entries}))",
    ]
    for r in range(rounds + 1):
        d = "list_sum(list_transform(range(1, w + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint"
        text.append(f"own{r} as materialized (select vec_id, label, p, x, w, min(struct_pack(d := d, e := e)) best from (select t.*, b.e, {d} d from part t join book{r} b using (p)) group by all)")
        if r < rounds:
            mean = "list(m order by i)"
            text.append(f"sum{r} as (select p, e, {mean} c from (select p, best.e e, i.i, floor(sum(x[i.i])::hugeint / count(*))::bigint m from own{r}, (select unnest(range(1, (select max(w) from kept) + 1)) i) i group by 1, 2, 3) group by 1, 2)")
            text.append(f"book{r + 1} as materialized (select b.p, b.e, coalesce(s.c, b.c) c from book{r} b left join sum{r} s on s.p = b.p and s.e = b.e)")
    last = rounds
    text.append(f"digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) h from book{last})")
    text.append(f"rows as (select vec_id, label, string_agg(printf('%02x', best.e), '' order by p) code, sum(best.d)::bigint error from own{last} group by vec_id, label)")
    return ",\n".join(text) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, h codebooks_sha256 from rows, digest"
