"""What the text operators share: the contract's word rules on UTF-8 bytes, and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Lower-cases A-Z only; bytes above 0x7F stay, so multi-byte letters stay whole.
FOLD = bytes(_UPPER.get(c, c) for c in range(256))
#: As FOLD, and turns all ASCII but 0-9 and a-z into spaces: the words are then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = bytes(
    _UPPER.get(c, c) if c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; ``bytes.split`` cuts at exactly these six bytes."""
    return text.translate(FOLD).split()


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def utf8(col: Column | str) -> Column:
    """Text as bytes: Python gets it without decoding. Null is empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def fold_bucket(key: Column, parts: int) -> Column:
    """crc32 of the key's decimal text modulo ``parts``: the split of rows into training and held-out ones."""
    return F.crc32(key.cast("string").cast("binary")) % parts


#: Rows and bytes of an Arrow batch, where the session leaves Spark's defaults: texts can be long, and both the JVM and
#: Python hold whole batches.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


#: What this worker keeps for later tasks of the operator that made it.
_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What this worker keeps under ``key``; inside an ``arrow_map`` that ``keeps`` it, it is made once."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def _drop_others(keeps: Hashable) -> None:
    for key in [k for k in _HELD if k != keeps]:
        del _HELD[key]
        gc.collect()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, keeps: Hashable = None) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size. A worker keeps what is ``held`` under ``keeps`` for further tasks, and
    nothing of other operators: workers live on from operator to operator, and each would add its own."""
    conf = df.sparkSession.conf
    for name, default, ours in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
        if conf.get(f"spark.sql.execution.arrow.{name}") == default:
            conf.set(f"spark.sql.execution.arrow.{name}", ours)

    def run(batches):
        _drop_others(keeps)
        try:
            yield from fn(batches)
        finally:  # a worker lives on for other tasks, beside a JVM that needs the memory
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """What this process no longer uses goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], col: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most ``limit`` bytes of ``col`` (or one row): memory stays bounded with long texts."""
    for b in batches:
        at, size = 0, 0
        for i, n in enumerate(pc.binary_length(b.column(col)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if at < b.num_rows:
            yield b.slice(at)


def least_count(counted: DataFrame, most: int, count: str = "n") -> int:
    """The lowest value of ``count`` that ``most`` rows at most reach: a threshold instead of a sort through one task.
    Only the distinct values come to the driver; a corpus of T words has fewer than the root of 2 T."""
    below = [(r[0], r[1]) for r in counted.groupBy(count).count().collect()]
    least, total = 0, 0
    for n, rows in sorted(below, reverse=True):
        total += rows
        if total > most:
            return n + 1
        least = n
    return least
