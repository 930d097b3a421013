"""Work that can stop and go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.tables import global_rank
from tessera.sources.files import exists
from tessera.storage import materialize, scratch


def pending(todo: DataFrame, done: DataFrame, key: str, terminal: tuple[str, ...] = ("found", "not_found")) -> DataFrame:
    """What has no terminal status yet; a retryable failure stays pending."""
    return todo.join(done.where(F.col("status").isin(*terminal)).select(key), key, "left_anti")


def resume(spark: SparkSession, todo: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], batch: int = 1000) -> DataFrame:
    """Appends ``work``'s rows (with ``status``) to the status table at ``path``, ``batch`` keys a time.

    Each append commits whole; a run that dies loses its open batch only. Keys that fail again are left for the next run.
    """
    left = pending(todo, spark.read.parquet(path), key) if exists(spark, path) else todo
    with scratch(spark):  # the batches are dealt once, by ranges of the key, before the status table changes
        dealt = materialize(global_rank(left, F.col(key), "_place").withColumn("_batch", F.floor((F.col("_place") - 1) / batch)), "batches")
        for k in range(-(-dealt.count() // batch)):
            work(dealt.where(F.col("_batch") == k).drop("_place", "_batch")).write.mode("append").parquet(path)
    return spark.read.parquet(path) if exists(spark, path) else todo.limit(0)


def stream_new_files(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]):
    """The same as a stream: every file of ``source`` once, ``availableNow``, exactly once by the checkpoint."""
    query = work(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return spark.read.parquet(sink)
