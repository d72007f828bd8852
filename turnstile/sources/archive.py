"""Comment archives: NDJSON (plain or zstd) to canonical comments, batch or stream, and a command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Every field is read as text, so that a line with an odd number is not dropped as malformed; casts follow.
RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "author", "body", "created_utc", "subreddit", "score", "link_id")])
DELETED = ("[deleted]", "[removed]")


@dataclass(frozen=True)
class ArchiveOptions:
    start: str | None = None
    end: str | None = None
    subreddits: tuple[str, ...] = ()
    min_body_length: int = 15
    include_deleted: bool = False
    source: str = "pushshift_archive"


def epoch_of_day(day: str) -> Column:
    """Seconds at 00:00 UTC of YYYY-MM-DD."""
    return F.unix_date(F.to_date(F.lit(day))).cast("long") * 86400


def accept(raw: DataFrame, options: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    """Rows with a body long enough, not deleted, from an allowed community, and an integer time in the closed range."""
    keep = F.col("body").isNotNull() & (F.length("body") >= options.min_body_length)
    if not options.include_deleted:
        keep &= ~F.trim("body").isin(*DELETED)
    if options.subreddits:
        keep &= F.lower("subreddit").isin(*[s.lower() for s in options.subreddits])
    at = F.expr("try_cast(created_utc AS BIGINT)")
    keep &= at.isNotNull() & ~F.coalesce(F.col("created_utc").cast("string").contains("."), F.lit(False))
    if options.start:
        keep &= at >= epoch_of_day(options.start)
    if options.end:
        keep &= at <= epoch_of_day(options.end)
    return raw.filter(keep)


def canonical(raw: DataFrame, source: str) -> DataFrame:
    """Canonical comments; a missing author is [deleted], an unusable score 0, rows without id are dropped."""
    score = F.expr("try_cast(try_cast(score AS DOUBLE) AS INT)")
    return raw.filter("id IS NOT NULL").select("id", F.coalesce("author", F.lit("[deleted]")).alias("author"), "body", F.expr("try_cast(created_utc AS BIGINT)").alias("created_utc"), F.lower(F.coalesce("subreddit", F.lit(""))).alias("subreddit"), F.coalesce(score, F.lit(0)).alias("score"), F.coalesce("link_id", F.lit("")).alias("link_id"), F.lit(source).alias("source"))


class ArchiveSource:
    """Archives below a folder; read() and stream() give the same columns."""

    def __init__(self, path: str, options: ArchiveOptions = ArchiveOptions(), suffixes: str = "{zst,jsonl,ndjson}"):
        self.path, self.options, self.suffixes = path, options, suffixes

    def _rows(self, reader) -> DataFrame:
        reader = reader.schema(RAW).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{self.suffixes}")
        return canonical(accept(reader.json(self.path), self.options), self.options.source)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark.read)

    def stream(self, spark: SparkSession, files_per_trigger: int = 100) -> DataFrame:
        return self._rows(spark.readStream.option("maxFilesPerTrigger", files_per_trigger))

    def materialize(self, spark: SparkSession, out: str, rows_per_file: int = 100_000) -> int:
        """Write snappy Parquet; the rows written are counted on the way."""
        seen = Observation("archive")
        self.read(spark).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").parquet(out)
        return seen.get["rows"]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="turnstile-archive", description="Comment archives to canonical Parquet")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--subreddits", default="")
    p.add_argument("--min-body-length", type=int, default=15)
    p.add_argument("--include-deleted", action="store_true")
    p.add_argument("--log-level", default="WARN")
    a = p.parse_args(argv)
    from turnstile.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel(a.log_level.upper())
    options = ArchiveOptions(a.start, a.end, tuple(s for s in a.subreddits.split(",") if s), a.min_body_length, a.include_deleted)
    print(ArchiveSource(a.input, options).materialize(spark, a.output))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
