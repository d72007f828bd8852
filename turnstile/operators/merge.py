"""Keyed merges into Parquet tables: upsert, insert-ignore."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], refreshed_at: str | None = None) -> DataFrame:
    """Source rows replace target rows of the same key; of repeated source keys the last by all columns wins."""
    rest = [c for c in source.columns if c not in keys]
    one = source.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else source.dropDuplicates(keys)
    if refreshed_at:
        one = one.withColumn(refreshed_at, F.current_timestamp())
    return target.join(one, keys, "left_anti").unionByName(one, allowMissingColumns=True)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the source rows whose key is new."""
    return target.unionByName(new_rows(target, source, keys), allowMissingColumns=True)


def new_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The source rows that insert_ignore adds, for their count; of repeated source keys the first by all columns."""
    rest = [c for c in source.columns if c not in keys]
    one = source.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else source.dropDuplicates(keys)
    return one.join(target.select(*keys), keys, "left_anti")


def swap_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside the table, then rename the old one away and the new one in; readers that open the table between
    the two renames find none and have to try again."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.parquet(new)
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(old))
    fs.rename(fs_path(new), fs_path(path))
    fs.delete(fs_path(old), True)
