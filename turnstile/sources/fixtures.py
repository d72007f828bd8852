"""Fixtures and goal events from nested JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPETITIONS = "competition_id INT, season_id INT, competition_name STRING, season_name STRING"
FIXTURES = "match_id BIGINT, home_team STRUCT<home_team_name STRING>, away_team STRUCT<away_team_name STRING>, match_date STRING, home_score INT, away_score INT"
EVENTS = "minute INT, team STRUCT<name STRING>, player STRUCT<name STRING>, shot STRUCT<outcome STRUCT<name STRING>, statsbomb_xg DOUBLE>"

# Unordered pairs that are rivalries, compared as written.
RIVALRIES = (("Barcelona", "Real Madrid"), ("Manchester United", "Liverpool"), ("Arsenal", "Tottenham Hotspur"), ("Inter", "AC Milan"), ("Boca Juniors", "River Plate"))


def _read(spark: SparkSession, schema: str, path) -> DataFrame:
    """Broken or missing files are skipped."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").json(path)


def competitions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, COMPETITIONS, path)


def is_rivalry(home: Column, away: Column, pairs=RIVALRIES) -> Column:
    key = F.concat_ws("|", F.least(home, away), F.greatest(home, away))
    return F.coalesce(key.isin(*("|".join(sorted(p)) for p in pairs)), F.lit(False))


def fixtures(spark: SparkSession, path, competition: DataFrame | None = None, competition_ids: list[int] | None = None, pairs=RIVALRIES) -> DataFrame:
    """Flat fixtures; files lie in .../<competition_id>/<season_id>.json, by which the competition's names are joined."""
    raw = _read(spark, FIXTURES, path).withColumn("__path", F.col("_metadata.file_path"))
    ids = F.regexp_extract("__path", r"/(\d+)/(\d+)\.json$", 1), F.regexp_extract("__path", r"/(\d+)/(\d+)\.json$", 2)
    raw = raw.withColumns({"__cid": ids[0], "__sid": ids[1]})
    if competition_ids is not None:
        raw = raw.filter(F.col("__cid").isin(*map(str, competition_ids)))
    if competition is not None:
        names = competition.select(F.col("competition_id").cast("string").alias("__cid"), F.col("season_id").cast("string").alias("__sid"), F.col("competition_name").alias("competition"), F.col("season_name").alias("season"))
        raw = raw.join(names, ["__cid", "__sid"], "left")
    else:
        raw = raw.withColumns({"competition": F.lit(None).cast("string"), "season": F.lit(None).cast("string")})
    home, away = F.col("home_team.home_team_name"), F.col("away_team.away_team_name")
    return raw.select("match_id", home.alias("home_team"), away.alias("away_team"), "competition", "season", F.expr("try_to_date(match_date, 'yyyy-MM-dd')").alias("match_date"), "home_score", "away_score", is_rivalry(home, away, pairs).alias("is_rivalry"), (F.coalesce("home_score", F.lit(0)) + F.coalesce("away_score", F.lit(0))).alias("total_goals"))


def goal_events(spark: SparkSession, path) -> DataFrame:
    """Shots that were goals; the file's name is the match_id."""
    raw = _read(spark, EVENTS, path).select("*", F.expr("try_cast(regexp_extract(_metadata.file_name, '^([0-9]+)', 1) AS BIGINT)").alias("match_id"))
    return raw.filter("shot.outcome.name = 'Goal'").select("match_id", "minute", F.col("team.name").alias("team"), F.col("player.name").alias("player"), F.col("shot.statsbomb_xg").alias("xg"))


def goals_per_match(goals: DataFrame) -> DataFrame:
    return goals.groupBy("match_id").agg(F.count("*").alias("goal_events"))
