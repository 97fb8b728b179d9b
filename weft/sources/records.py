"""Small registries, key=value records and versioned snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPOSITORIES = "id string, name string, path string"
WORKSPACES = "id string, name string"


def read_registry(spark: SparkSession, path: str, schema: str = REPOSITORIES) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value from files of key=value lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    at = F.instr("value", "=")
    return lines.where(at > 0).select("file", F.substring_index("value", "=", 1).alias("key"), F.expr("substring(value, instr(value, '=') + 1)").alias("value"))


def write_snapshot(df: DataFrame, base: str, repository_col: str = "repository") -> str:
    """A new version beside the old ones, partitioned by repository; returns its path. Readers switch by path, so no reader sees half a version."""
    path = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.partitionBy(repository_col).parquet(path)
    return path


def refresh(previous: DataFrame, changed: DataFrame, repository_col: str = "repository") -> DataFrame:
    """previous with the rows of changed repositories replaced."""
    gone = changed.select(repository_col).distinct()
    return previous.join(gone, repository_col, "left_anti").unionByName(changed, allowMissingColumns=True)


def repository_state(files: DataFrame) -> DataFrame:
    """repository, signature: order-free, from path, size and content of every file."""
    one = F.xxhash64("rel_path", "size", "sha256").cast("decimal(38,0)")
    return files.groupBy("repository").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(one).cast("string")).alias("signature"))
