"""Streams of canonical comments: tumbling counts, and an idempotent keyed sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnstile.operators.linking import LinkerOptions, LinkingConfig, link


def tumbling_counts(comments: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Comments and mean score a community and window; rows later than the watermark are dropped."""
    timed = comments.withColumn("at", F.timestamp_seconds("created_utc")).withWatermark("at", late)
    per = timed.groupBy(F.window("at", every), "subreddit").agg(F.count("*").alias("comments"), F.avg("score").alias("avg_score"))
    return per.select(F.col("window.start").alias("start"), "subreddit", "comments", "avg_score")


def linked(comments: DataFrame, fixtures: DataFrame, config: LinkingConfig, options: LinkerOptions = LinkerOptions()) -> DataFrame:
    """The linker over a stream of comments and a table of fixtures: a stream-static interval join without state."""
    return link(comments, fixtures, config, options)


def deduplicated(comments: DataFrame, late: str = "2 hours") -> DataFrame:
    return comments.withColumn("at", F.timestamp_seconds("created_utc")).withWatermark("at", late).dropDuplicatesWithinWatermark(["id"]).drop("at")


def keyed_sink(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's new keys to a Parquet table, once, however often a batch is retried.

    A batch's rows go to their own folder, which a retry overwrites; keys of other folders are skipped.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        one = batch.dropDuplicates(keys)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            before = spark.read.schema(batch.schema.add("epoch", "bigint")).parquet(path).filter(F.col("epoch") < epoch)
            one = one.join(before.select(*keys), keys, "left_anti")
        one.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
