"""Paged and keyed HTTP sources. ``fetch(url) -> (status, text)`` is the caller's, so tests and offline runs need no network."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Statuses that a retry may mend, and the record statuses.
RETRYABLE = frozenset({408, 425, 429, 500, 502, 503, 504})
FOUND, NOT_FOUND, HTTP_ERROR, REQUEST_ERROR, INVALID = "found", "not_found", "http_error", "request_error", "invalid_payload"
Fetch = Callable[[str], tuple[int, str]]


def urllib_fetch(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


def lookup(url: str, fetch: Fetch, tries: int = 5, cap: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None]:
    """(status, payload); waits min(2^n, cap) seconds between tries of a retryable failure."""
    status = REQUEST_ERROR
    for n in range(tries):
        try:
            code, text = fetch(url)
        except OSError:
            status = REQUEST_ERROR
        else:
            if code == 404:
                return NOT_FOUND, None
            if code == 200:
                try:
                    json.loads(text)
                except ValueError:
                    return INVALID, None
                return FOUND, text
            status = HTTP_ERROR
            if code not in RETRYABLE:
                return status, None
        if n + 1 < tries:
            sleep(min(2.0**n, cap))
    return status, None


def lookup_all(entities: DataFrame, key: str, url: str, fetch: Fetch = urllib_fetch, per_second: float = 1.0) -> DataFrame:
    """(key, status, payload) for each key; ``url`` holds ``{key}``. Each task keeps to its own rate."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                began = time.monotonic()
                out.append((k, *lookup(url.format(key=k), fetch)))
                time.sleep(max(0.0, 1 / per_second - (time.monotonic() - began)))
            keys, status, payload = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(status, pa.string()), pa.array(payload, pa.string())], [key, "status", "payload"])

    kind = entities.schema[key].dataType.simpleString()
    return entities.select(key).mapInArrow(run, f"`{key}` {kind}, status string, payload string")


class _Page(InputPartition):
    def __init__(self, offset: int, onward: bool):
        self.offset, self.onward = offset, onward


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.url, self.limit, self.pages, self.field, self.fetch = options["url"], int(options.get("limit", 100)), int(options.get("pages", 0)), options.get("field", "items"), fetch

    def partitions(self):
        return [_Page(k * self.limit, False) for k in range(self.pages)] or [_Page(0, True)]

    def read(self, partition) -> Iterator[tuple]:
        offset = partition.offset
        while True:
            status, payload = lookup(self.url.format(limit=self.limit, offset=offset), self.fetch)
            if status != FOUND:
                raise RuntimeError(f"the page at {offset} ended as {status}")
            items = json.loads(payload).get(self.field, [])
            for i, item in enumerate(items):
                yield (offset + i, json.dumps(item))
            if not partition.onward or len(items) < self.limit:
                return
            offset += self.limit


class PagedSource(DataSource):
    """``spark.read.format("paged_http")``: (position, item JSON); one partition a page of ``limit`` items at ``offset``."""

    fetch: Fetch = staticmethod(urllib_fetch)

    @classmethod
    def name(cls):
        return "paged_http"

    def schema(self):
        return "position long, item string"

    def reader(self, schema):
        return _PagedReader(self.options, type(self).fetch)


def read_pages(spark: SparkSession, url: str, limit: int, total: int | None = None, field: str = "items") -> DataFrame:
    """Pages enough for ``total`` items, side by side (positions past a short page simply give no rows); without a
    total one task goes on until a page is short. A page that cannot be had fails the read."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_http").options(url=url, limit=limit, pages=-(-total // limit) if total else 0, field=field).load()


def flatten_media(df: DataFrame, release: str = "release") -> DataFrame:
    """A release's nested media and tracks as rows, with parent fields and list fields joined."""
    m = df.select(F.col(f"{release}.id").alias("release_id"), F.col(f"{release}.title").alias("release_title"), F.explode(f"{release}.media").alias("m"))
    t = m.select("release_id", "release_title", F.col("m.position").alias("disc_number"), F.posexplode("m.tracks").alias("i", "t"))
    return t.select("release_id", "release_title", "disc_number", (F.col("i") + 1).alias("track_position"), F.col("t.id").alias("track_id"), F.col("t.title").alias("track_title"), F.array_join("t.isrcs", ",").alias("isrcs"))
