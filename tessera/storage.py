"""Shared working storage: where intermediate tables are written so that every executor can read them back."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, taken from ``spark.checkpoint.dir``. A local session without one gets its own; on
    a cluster, whose machines do not share a local folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_LOCAL = threading.local()
#: Tables that results may still read, for ``release``.
_KEPT: set[str] = set()
_LOCK = threading.Lock()


def _open() -> list[list[str]]:
    """The paths of this thread's open scratches, the innermost last."""
    if not hasattr(_LOCAL, "scratches"):
        _LOCAL.scratches = []
    return _LOCAL.scratches


def _delete(spark: SparkSession, paths) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that this thread materializes inside are deleted at the end, but for those kept: what leaves must be kept."""
    _open().append([])
    try:
        yield
    finally:
        _delete(spark, _open().pop())


def materialize(df: DataFrame, label: str, keep: bool = False, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    Inside ``scratch`` the table lives as long as that; ``keep``: as long as the scratch around it, if there is one. A
    table without a scratch belongs to a result and lives until ``release`` or the end of the program. ``rows_a_file``
    (of large rows) is how many a file holds at most, so that readers can share them out.
    """
    spark, held = df.sparkSession, _open()
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    if len(held) > keep:
        held[-1 - keep].append(path)
    else:
        with _LOCK:
            _KEPT.add(path)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables (as ``materialize`` gave them) before their scratch ends: nothing may read them any more."""
    paths = [t._written for t in tables]
    for held in _open():
        held[:] = [x for x in held if x not in paths]
    with _LOCK:
        _KEPT.difference_update(paths)
    _delete(tables[0].sparkSession, paths)


def contained(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a function of tables (the first argument is one): its result is written and its other tables deleted."""

    @functools.wraps(fn)
    def run(first: DataFrame, *args, **options) -> DataFrame:
        with scratch(first.sparkSession):
            return materialize(fn(first, *args, **options), fn.__name__, keep=True)

    return run


def release(spark: SparkSession) -> None:
    """Deletes the tables behind earlier results; call it when they have been read."""
    with _LOCK:
        paths, _ = list(_KEPT), _KEPT.clear()
    _delete(spark, paths)


@atexit.register
def _release_at_end() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        if _KEPT and (spark := SparkSession.getActiveSession()) is not None:
            release(spark)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint when ``df`` (cheap to count: a materialized table) has at most ``max_rows`` rows, else ``df``
    itself, so that Spark shuffles it. ``max_rows`` times the row width is the proven bound of the broadcast."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
