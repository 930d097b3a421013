"""What the vector operators share: which vectors take part, exact whole numbers, lists of the best."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Sums of products up to here are exact in doubles; beyond it Python's integers are used.
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def finite(vector: Column) -> Column:
    """True for a vector (array<double>) that is not null and holds finite numbers only; an empty one counts."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """A row for each list; shorter ones are filled up with zeros to ``width`` or the longest."""
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    wide = max(int(size.max(initial=0)), width or 0)
    if len(size) and (size == wide).all():
        return flat[ends[0] : ends[-1]].reshape(len(size), wide)
    out = np.zeros((len(size), wide))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly, for a power of two: doubles, or Python's integers where a product overflows them."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * float(scale))
        if np.isfinite(scaled).all():
            return scaled
        return np.frompyfunc(lambda v: math.floor(v * scale) if abs(v * scale) < math.inf else int(v) * scale, 1, 1)(x).astype(object)


def integers(x: np.ndarray) -> np.ndarray:
    """Whole numbers as Python's integers."""
    return x if x.dtype == object else np.frompyfunc(int, 1, 1)(x).astype(object)


def largest(x: np.ndarray) -> float:
    """The largest magnitude; infinite if no double holds it."""
    if not x.size:
        return 0.0
    most = np.abs(x).max()
    return float(most) if most < 2**1000 else math.inf


def exact_pair(columns: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices (a term a row in ``columns``, a term a column in ``queries``) as they are, if all sums of their products are exact in doubles; else as integers."""
    if columns.dtype != object and queries.dtype != object and largest(columns) * largest(queries) * max(1, len(columns)) < EXACT:
        return columns, queries
    return integers(columns), integers(queries)


def rows_at_most(width: int, most: int, size: int = 8 << 20) -> int:
    """Rows of ``width`` doubles in a block of ``size`` bytes, ``most`` at most."""
    return max(1, min(most, size // (8 * max(1, width))))


def blocks(df: DataFrame, rows: int) -> Iterator[list]:
    """The rows of a table of queries, streamed through the driver in blocks of bounded size."""
    block = []
    for row in df.toLocalIterator():
        block.append(row)
        if len(block) == rows:
            yield block
            block = []
    if block:
        yield block


def filled(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def gather(batches: Iterator[pa.RecordBatch], most: int, column: str = "v", size: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables of ``most`` rows or ``size`` bytes of ``column``, whichever is reached first, from batches of any size."""
    held, rows, used = [], 0, 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            wide = b.column(column).slice(at)
            each = max(1, 8 * len(wide.flatten()) // max(1, len(wide)))
            n = min(b.num_rows - at, most - rows, max(1, (size - used) // each))
            held.append(b.slice(at, n))
            at, rows, used = at + n, rows + n, used + n * each
            if rows >= most or used + each > size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, used = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)
