"""Table and file sources and sinks. All file access goes through Spark's readers or Hadoop's file system, so any store works."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tessera.operators.contracts import ContractError, duplicate_keys, require_columns


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_keyed_parquet(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A whole table whose key must be there and unique."""
    df = require_columns(spark.read.parquet(path), [key])
    if duplicate_keys(df, key).limit(1).count():
        raise ContractError(f"{path}: {key} repeats")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """With a header; the schema is given or inferred."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """S3: an empty table of this schema where there is none."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def first_available(spark: SparkSession, roots: Sequence[str], name: str, schema: StructType | str | None = None) -> DataFrame:
    """The first of ``root/name.parquet`` and ``root/name.csv`` over the roots, Parquet before CSV in each."""
    for root in roots:
        for end in ("parquet", "csv"):
            path = f"{root.rstrip('/')}/{name}.{end}"
            if exists(spark, path):
                return spark.read.parquet(path) if end == "parquet" else read_csv(spark, path)
    if schema is not None:
        return spark.createDataFrame([], schema)
    raise FileNotFoundError(f"{name} under none of {list(roots)}")


def read_json_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One JSON array of records a file."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_by_key(spark: SparkSession, folder: str, entities: DataFrame, key: str) -> DataFrame:
    """Entities with ``document`` (VARIANT) from ``folder/<key>.json``, null where there is no file or no valid JSON."""
    files = spark.read.option("wholetext", True).text(f"{folder.rstrip('/')}/*.json").select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("_file"), F.try_parse_json("value").alias("document")
    )
    return entities.join(files, F.col(key).cast("string") == F.url_decode("_file"), "left").drop("_file")


def discover(spark: SparkSession, root: str, extensions: Iterable[str]) -> DataFrame:
    """(path, length, modified) of files below ``root`` with one of the extensions, any case; contents are not read."""
    ends = "|".join(e.lower().lstrip(".") for e in extensions)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(F.lower("path").rlike(rf"\.(?:{ends})$")).select("path", "length", F.col("modificationTime").alias("modified"))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """One row (files, bytes) of a listing by ``discover``."""
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def missing_files(manifest: DataFrame, required: Iterable[str]) -> DataFrame:
    """Required file names that the manifest lacks."""
    spark = manifest.sparkSession
    names = spark.createDataFrame([(r,) for r in required], "name string")
    return names.join(manifest.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name")), "name", "left_anti")


def write_table(df: DataFrame, path: str, csv_twin: bool = False) -> None:
    """Parquet, and as an option a CSV twin beside it; Spark's committer makes either whole or absent."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    if csv_twin:
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_json(df: DataFrame, path: str) -> None:
    """S11."""
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, line: str, *order: str) -> None:
    """Text lines in order, one sorted range a file."""
    df.orderBy(*order).select(line).write.mode("overwrite").text(path)
