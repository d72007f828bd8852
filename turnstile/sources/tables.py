"""Tables of the warehouse as declared schemas, file sinks, and the catalog of views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "matches": "match_id BIGINT, home_team STRING, away_team STRING, competition STRING, season STRING, match_date DATE, home_score INT, away_score INT, is_rivalry BOOLEAN, total_goals INT",
    "goal_events": "match_id BIGINT, minute INT, team STRING, player STRING, xg DOUBLE",
    "match_sentiment": "match_id BIGINT, comment_count BIGINT, weighted_comment_count DOUBLE, avg_sentiment DOUBLE, sentiment_volatility DOUBLE, positive_ratio DOUBLE, negative_ratio DOUBLE, peak_hour_count BIGINT, unique_subreddits BIGINT, volume_norm DOUBLE, affect_norm DOUBLE, volatility_norm DOUBLE, reach_norm DOUBLE, engagement_score DOUBLE",
    "fan_segments": "author STRING, segment STRING, primary_subreddit STRING, comment_frequency BIGINT, matches_covered BIGINT, avg_sentiment DOUBLE, sentiment_volatility DOUBLE, positive_ratio DOUBLE, engagement_activity DOUBLE, silhouette_score DOUBLE",
    "fan_sentiment": "source STRING, external_id STRING, comment STRING, upvotes INT, posted_at TIMESTAMP, sentiment_score DECIMAL(5,4), sentiment_label STRING, emotion STRING, match_id BIGINT",
    "engagement_metrics": "match_id BIGINT, comment_volume INT, upvote_total INT, goal_events INT, avg_sentiment DECIMAL(5,4), engagement_score DECIMAL(8,2), excitement_index DECIMAL(8,2), match_hype_score DECIMAL(8,2), computed_at TIMESTAMP",
}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).option("header", "true").csv(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", "true").csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Needs a driver jar on the cluster."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def live_items(spark: SparkSession, path: str) -> DataFrame:
    """Items dropped as JSON files: deleted ones skipped, one row a (source, external_id)."""
    raw = spark.read.schema("source STRING, external_id STRING, comment STRING, upvotes INT, posted_at BIGINT").json(path)
    kept = raw.filter("comment IS NOT NULL AND trim(comment) NOT IN ('', '[deleted]', '[removed]')")
    return dedupe_items(kept.withColumn("posted_at", F.timestamp_seconds("posted_at")))


def dedupe_items(items: DataFrame) -> DataFrame:
    """One row a (source, external_id): the smallest by the other columns, so that reruns agree."""
    keys = ["source", "external_id"]
    rest = [c for c in items.columns if c not in keys]
    return items.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*")


def build_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Register views, the engagement view last; returns their row counts."""
    missing = {"matches", "engagement_raw"} - tables.keys()
    if missing:
        raise ValueError(f"missing tables: {sorted(missing)}")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    spark.sql("CREATE OR REPLACE TEMP VIEW engagement AS SELECT r.*, m.home_team, m.away_team, m.match_date, m.home_score, m.away_score, m.is_rivalry, m.total_goals, m.home_team || ' vs ' || m.away_team AS match_label, CAST(m.home_score AS INT) || '-' || CAST(m.away_score AS INT) AS score_str FROM engagement_raw r LEFT JOIN matches m USING (match_id)")
    return {name: spark.table(name).count() for name in (*tables, "engagement")}
