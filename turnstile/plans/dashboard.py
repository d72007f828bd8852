"""The dashboard's queries: one SQL text each, run over frames in Spark and over common table expressions in DuckDB.

The two texts differ where the engines do: {double}, {dec} casts, and list functions; names in braces are relations.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions.exprs import mean
from turnstile.operators import grouped
from turnstile.plans import relations as rel

DEC = "DECIMAL(18, 3)"
TYPE = "CASE WHEN is_rivalry THEN 'Rivalry' ELSE 'Non-rivalry' END"
LABEL = "home_team || ' vs ' || away_team"
JOINED = "{matches} m JOIN {match_sentiment} ms USING (match_id)"
PICK = "(SELECT min(match_id) FROM {enriched})"
R = lambda x, n=6: f"round({x}, {n})"
SEGMENT_PROFILE = f"""SELECT segment, count(*) AS authors, CAST(round(CAST(avg(comment_frequency) AS {DEC}), 1) AS DECIMAL(18, 1)) AS avg_comments, CAST(round(CAST(avg(matches_covered) AS {DEC}), 2) AS DECIMAL(18, 2)) AS avg_matches,
  CAST(round(CAST(avg(engagement_activity) AS {DEC}), 1) AS DECIMAL(18, 1)) AS avg_activity, CAST(round(CAST(avg(positive_ratio) AS {DEC}), 3) AS DECIMAL(18, 3)) AS avg_pos_ratio FROM {{fan_segments}} GROUP BY segment"""


def _divergence(where: str) -> str:
    return f"SELECT match_id, {LABEL} AS match_label, score_str, {R('engagement_score_football_norm')} AS football, {R('engagement_score_fans')} AS fans, {R('engagement_score_fans - engagement_score_football_norm')} AS divergence, total_goals, is_rivalry, {TYPE} AS category FROM {{ranking}} WHERE 1 = 1 {where}"


def _top(label: str) -> str:
    return f"SELECT comment_id, body, score AS upvotes, subreddit AS sub FROM {{enriched}} WHERE match_id = {PICK} AND sentiment_label = '{label}' AND minutes_from_kickoff BETWEEN 0 AND 150 ORDER BY score DESC, comment_id LIMIT 5"


SQL = {
    "kpi_headline": f"SELECT CAST(sum(fan_comment_count) AS INT) AS total_comments, {R('avg(engagement_score_combined)')} AS avg_combined, {R('avg(engagement_score_football_norm)')} AS avg_football, {R('avg(engagement_score_fans)')} AS avg_fans, count(*) FILTER (WHERE is_rivalry) AS n_rivalry, count(*) AS n_matches FROM {{ranking}}",
    "rivalry_premium": f"SELECT {R('r')} AS rivalry_avg, {R('n')} AS non_rivalry_avg, {R('(r - n) / nullif(n, 0)')} AS premium_pct FROM (SELECT avg(CASE WHEN is_rivalry THEN engagement_score_combined END) AS r, avg(CASE WHEN NOT is_rivalry THEN engagement_score_combined END) AS n FROM {{ranking}})",
    "kpi_top_match": f"SELECT {LABEL} AS match_label, score_str, total_goals, {R('engagement_score_combined')} AS combined FROM {{ranking}} WHERE rank = 1",
    "divergence_all": _divergence(""),
    "divergence_rivalry": _divergence("AND is_rivalry"),
    "divergence_non": _divergence("AND NOT is_rivalry"),
    "ranking_bar": f"SELECT rank, {LABEL} AS match_label, {R('engagement_score_combined')} AS score, {TYPE} AS category FROM {{ranking}} ORDER BY rank",
    "ranking_detail": f"SELECT rank AS `#`, {LABEL} AS `Match`, match_date AS `Date`, score_str AS `Score`, total_goals AS `Goals`, is_rivalry AS `Rivalry`, fan_comment_count AS `Fan comments`, {R('engagement_score_fans')} AS `Fan score`, {R('engagement_score_football_norm')} AS `Football score`, {R('engagement_score_combined')} AS `Combined` FROM {{ranking}} ORDER BY rank",
    "segment_profile": SEGMENT_PROFILE,
    **{f"segment_{k}": f"SELECT * FROM ({SEGMENT_PROFILE}) WHERE segment = '{v}'" for k, v in (("casual", "Casual Fan"), ("tactical", "Tactical Fan"), ("highly", "Highly Engaged Fan"), ("ultra", "Ultra Fan"))},
    "segment_metrics_long": """WITH base AS (SELECT segment, avg(comment_frequency) AS c, avg(matches_covered) AS m, avg(avg_sentiment) AS s, avg(sentiment_volatility) AS v, avg(positive_ratio) AS p FROM {fan_segments} GROUP BY segment)
SELECT segment, 'Avg comments / author' AS metric, round(c, 6) AS value FROM base UNION ALL SELECT segment, 'Matches covered', round(m, 6) FROM base UNION ALL SELECT segment, 'Avg sentiment', round(s, 6) FROM base
UNION ALL SELECT segment, 'Volatility', round(v, 6) FROM base UNION ALL SELECT segment, 'Positive ratio', round(p, 6) FROM base""",
    "author_scatter": "SELECT author, matches_covered, engagement_activity, comment_frequency, segment, CASE WHEN segment = 'Casual Fan' THEN 1 WHEN segment = 'Tactical Fan' THEN 2 WHEN segment = 'Highly Engaged Fan' THEN 3 ELSE 4 END AS segment_order FROM {fan_segments}",
    "top_voices": f"SELECT author AS `Author`, segment AS `Segment`, primary_subreddit AS `Sub`, comment_frequency AS `Comments`, matches_covered AS `Matches`, {R('avg_sentiment')} AS `Avg sentiment`, {R('sentiment_volatility')} AS `Volatility`, {R('positive_ratio')} AS `% positive` FROM {{fan_segments}} ORDER BY engagement_activity DESC, author LIMIT 15",
    "match_list": f"SELECT match_id, {LABEL} || ' (' || home_score || '-' || away_score || ')' || CASE WHEN is_rivalry THEN '  *' ELSE '' END AS match_label, match_date FROM {{matches}}",
    "match_meta": f"SELECT match_id, {LABEL} AS match_label, home_score || '-' || away_score AS score_str, match_date, total_goals, is_rivalry, comment_count, {R('avg_sentiment')} AS avg_sentiment, {R('sentiment_volatility')} AS sentiment_volatility, {R('positive_ratio')} AS positive_ratio, {R('negative_ratio')} AS negative_ratio, peak_hour_count, {R('engagement_score')} AS engagement_score FROM {JOINED} WHERE match_id = {PICK}",
    "goals_timeline": "SELECT minute, team, player, round(xg, 6) AS xg, team AS series FROM {goal_events} WHERE match_id = 0",
    "comment_curve": "SELECT CAST(floor(minutes_from_kickoff / 15) * 15 AS DOUBLE) AS min_from_ko, count(*) AS comments, round(avg(sentiment), 6) AS avg_sentiment FROM {enriched} WHERE minutes_from_kickoff BETWEEN -30 AND 180 GROUP BY 1",
    "sentiment_mix": "SELECT sentiment_label, count(*) AS comments, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS DOUBLE) AS share_pct FROM {enriched} WHERE match_id = " + PICK + " GROUP BY sentiment_label",
    "top_pos": _top("positive"),
    "top_neg": _top("negative"),
    "season_kpis": f"SELECT CAST(round(CAST(avg(avg_sentiment) AS {DEC}), 3) AS DECIMAL(18, 3)) AS season_avg, CAST(round(CAST(avg(sentiment_volatility) AS {DEC}), 3) AS DECIMAL(18, 3)) AS season_volatility, CAST(round(CAST(avg(positive_ratio) AS {DEC}), 3) AS DECIMAL(18, 3)) AS season_pos_ratio, (SELECT {LABEL} FROM {JOINED} ORDER BY round(avg_sentiment, 9) DESC, match_id LIMIT 1) AS most_positive_match, (SELECT {LABEL} FROM {JOINED} ORDER BY round(sentiment_volatility, 9) DESC, match_id LIMIT 1) AS most_volatile_match FROM {{match_sentiment}}",
    "sentiment_timeline": f"SELECT match_date, {LABEL} AS match_label, {R('avg_sentiment')} AS avg_sentiment, {R('sentiment_volatility')} AS sentiment_volatility, {R('positive_ratio')} AS positive_ratio, {R('negative_ratio')} AS negative_ratio, comment_count, {TYPE} AS category FROM {JOINED}",
    "volatility_bar": f"SELECT {LABEL} AS match_label, {R('sentiment_volatility')} AS sentiment_volatility, match_date, {TYPE} AS category FROM {JOINED}",
    "posneg_long": f"WITH base AS (SELECT match_date, {LABEL} AS match_label, positive_ratio, negative_ratio FROM {JOINED}) SELECT match_date, match_label, 'Positive' AS polarity, round(positive_ratio, 6) AS share FROM base UNION ALL SELECT match_date, match_label, 'Negative', round(negative_ratio, 6) FROM base",
    "mood_table": f"SELECT CAST(rank() OVER (ORDER BY round(sentiment_volatility, 9) DESC) AS BIGINT) AS `Rank by volatility`, {LABEL} AS `Match`, match_date AS `Date`, CASE WHEN is_rivalry THEN 'Rivalry' ELSE 'League' END AS `Type`, comment_count AS `Comments`, {R('avg_sentiment')} AS `Avg sentiment`, {R('positive_ratio')} AS `% positive` FROM {JOINED}",
    "data_sources": "SELECT * FROM (VALUES ('matches', 'one row a fixture', 'Fixtures, scores and the rivalry flag'), ('goal_events', 'one row a goal', 'Minute, scorer and expected goals'), ('links', 'one row a comment and fixture', 'Confidence and reasons'), ('match_sentiment', 'one row a fixture', 'Volume, polarity and volatility'), ('fan_segments', 'one row an author', 'Segment and features'), ('ranking', 'one row a fixture', 'Combined scores in order')) AS t(table_name, row_count, what_it_holds)",
    "link_confidence_hist": "SELECT round(link_confidence, 1) AS confidence, count(*) AS comments FROM {links} GROUP BY 1",
    "executive_overview": f"SELECT m.match_id, home_team, away_team, competition, match_date, total_goals, is_rivalry, comment_count AS comment_volume, {R('avg_sentiment')} AS avg_sentiment, {R('engagement_score')} AS engagement_score FROM {{matches}} m LEFT JOIN {{match_sentiment}} e USING (match_id)",
    "engagement_view": f"SELECT match_id, {R('engagement_score_football_raw')} AS football_raw, {R('engagement_score_combined')} AS combined, home_team, away_team, match_date, is_rivalry, total_goals, {LABEL} AS match_label, CAST(home_score AS INT) || '-' || CAST(away_score AS INT) AS score FROM {{combined}} LEFT JOIN {{matches}} USING (match_id)",
    "overview_top10": f"SELECT match_id, {R('engagement_score')} AS engagement_score, comment_count FROM {{matches}} LEFT JOIN {{match_sentiment}} USING (match_id) ORDER BY round(engagement_score, 9) DESC NULLS LAST, match_id LIMIT 10",
    "label_distribution": "SELECT sentiment_label, count(*) AS n FROM {enriched} GROUP BY sentiment_label",
    "table_counts": "SELECT 'matches' AS name, count(*) AS n FROM {matches} UNION ALL SELECT 'matches with rivalry', count(*) FROM {matches} WHERE is_rivalry UNION ALL SELECT 'links', count(*) FROM {links} UNION ALL SELECT 'goal_events', count(*) FROM {goal_events} UNION ALL SELECT 'match_sentiment', count(*) FROM {match_sentiment} UNION ALL SELECT 'ranking first is rivalry', count(*) FROM {ranking} WHERE rank = 1 AND is_rivalry",
    "sources_projected": "SELECT comment_id, author, score AS upvotes, subreddit, round(minutes_from_kickoff, 6) AS minutes_from_kickoff FROM {enriched}",
    "weekly_polarity": "SELECT CAST(date_trunc('week', {from_epoch}) AS DATE) AS week, count(*) FILTER (WHERE score >= 53) AS positive, count(*) FILTER (WHERE score <= 47) AS negative, round(avg(sentiment), 6) AS avg_sentiment FROM {comments} GROUP BY 1",
    "community_compare": "SELECT subreddit, count(*) AS comments, round(avg(sentiment), 6) AS avg_sentiment FROM {comments} GROUP BY subreddit",
    "dax_measures": f"SELECT {R('avg(engagement_score)')} AS avg_engagement, {R('max(engagement_score)')} AS max_engagement, CAST(sum(comment_count) AS BIGINT) AS comments, count(*) AS fixtures, count(*) FILTER (WHERE round(avg_sentiment, 9) > 0) AS positive_fixtures, {R('stddev_pop(avg_sentiment)')} AS spread, count(DISTINCT competition) AS competitions FROM {JOINED}",
    "link_reason_freq": "SELECT reason, count(*) AS n FROM (SELECT {explode_reasons} AS reason FROM {links}) GROUP BY reason ORDER BY n DESC, reason LIMIT 10",
    "pearson": "SELECT round(corr(avg_sentiment, comment_count), 6) AS pearson FROM {match_sentiment}",
    "link_confidence": "SELECT match_id, comment_id, subreddit, created_utc, match_epoch, round(minutes_from_kickoff, 6) AS minutes_from_kickoff, link_confidence, link_reasons FROM {links}",
    "match_features": f"SELECT match_id, comment_count, {R('weighted_comment_count')} AS weighted_comment_count, {R('avg_sentiment')} AS avg_sentiment, {R('sentiment_volatility')} AS sentiment_volatility, {R('positive_ratio')} AS positive_ratio, {R('negative_ratio')} AS negative_ratio, peak_hour_count, unique_subreddits FROM {{match_features}}",
    "fan_composite": f"SELECT match_id, {R('volume_norm')} AS volume_norm, {R('affect_norm')} AS affect_norm, {R('volatility_norm')} AS volatility_norm, {R('reach_norm')} AS reach_norm, {R('engagement_score')} AS engagement_score FROM {{match_sentiment}}",
    "football_blend": f"SELECT match_id, {R('engagement_score_football_norm')} AS football_norm, {R('engagement_score_fans')} AS fans, fan_comment_count, {R('engagement_score_combined')} AS combined FROM {{combined}}",
    "engagement_rank": f"SELECT rank, match_id, {R('engagement_score_combined')} AS combined, score_str FROM {{ranking}}",
    "author_features": f"SELECT author, comment_frequency, {R('avg_sentiment')} AS avg_sentiment, {R('sentiment_volatility')} AS sentiment_volatility, engagement_activity, matches_covered, {R('positive_ratio')} AS positive_ratio, primary_subreddit FROM {{fan_segments}}",
    "describe_sentiment": "SELECT count(sentiment) AS n, round(avg(sentiment), 6) AS mean, round(stddev_samp(sentiment), 6) AS std, min(sentiment) AS lowest, "
    + ", ".join(f"round(percentile_cont({q / 100}) WITHIN GROUP (ORDER BY sentiment), 6) AS p{q}" for q in (25, 50, 75))
    + ", max(sentiment) AS highest FROM {comments}",
    "daily_mean": "SELECT CAST(date_trunc('day', {from_epoch}) AS DATE) AS day, count(*) AS comments, round(avg(sentiment), 6) AS avg_sentiment FROM {comments} GROUP BY 1",
    "divergence_top5": _divergence("ORDER BY round(engagement_score_fans - engagement_score_football_norm, 9) DESC, match_id LIMIT 5"),
    "divergence_bottom5": _divergence("ORDER BY round(engagement_score_fans - engagement_score_football_norm, 9), match_id LIMIT 5"),
    "link_sample": "SELECT match_id, comment_id, link_confidence, link_reasons FROM {links} ORDER BY link_confidence DESC, match_id, comment_id LIMIT 20",
    "team_list": "SELECT DISTINCT team FROM (SELECT home_team AS team FROM {matches} UNION ALL SELECT away_team AS team FROM {matches})",
    "gen1_social": "SELECT match_id, count(*) AS comment_volume, CAST(sum(score) AS BIGINT) AS upvote_total, count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_comments, count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_comments FROM {enriched} GROUP BY match_id",
    "peak_hour": "SELECT match_id, peak_hour_count FROM {match_features}",
}

SPARK = {"from_epoch": "timestamp_seconds(created_utc)", "explode_reasons": "explode(split(link_reasons, ';'))"}
DUCK = {"from_epoch": "make_timestamp(created_utc * 1000000)", "explode_reasons": "unnest(string_split(link_reasons, ';'))"}
_NAME = re.compile(r"\{(\w+)\}")


def _fill(sql: str, words: dict[str, str]) -> str:
    return _NAME.sub(lambda m: words.get(m[1], m[0]), sql)


def spark_query(name: str):
    sql = _fill(SQL[name], SPARK)
    needs = sorted(set(_NAME.findall(sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: rel.FRAMES[n](spark, sf_dir) for n in needs})

    run.__name__ = name
    return run


def oracle(name: str) -> str:
    sql = _fill(SQL[name], DUCK).replace("`", '"')
    needs = sorted(set(_NAME.findall(sql)))
    body = _NAME.sub(lambda m: m[1], sql)
    ctes = rel.with_ctes("", *needs).rstrip()
    if not ctes:
        return body
    return f"{ctes},\n{body[5:]}" if body.startswith("WITH ") else f"{ctes}\n{body}"


def daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL's columns with an exact mean: sums of doubles fall to either side of a tie by the order of the rows."""
    day = F.date_trunc("day", F.timestamp_seconds("created_utc")).cast("date").alias("day")
    return rel.comments(spark, sf_dir).groupBy(day).agg(F.count("*").alias("comments"), F.round(mean(F.col("sentiment")), 6).alias("avg_sentiment"))


def comment_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL's columns without the links, with an exact mean."""
    curve = grouped.curve(rel.comments(spark, sf_dir), rel.matches(spark, sf_dir), rel.CONFIG, rel.LINK)
    return curve.withColumn("avg_sentiment", F.round("avg_sentiment", 6))


def gen1_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.link_sums(spark, sf_dir)
    return s.select("match_id", F.col("comments").alias("comment_volume"), F.col("upvotes").cast("long").alias("upvote_total"), F.col("positive").alias("positive_comments"), F.col("negative").alias("negative_comments"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL's rows; the links are counted a fixture, and fixtures get their features once."""
    matches, fans = rel.matches(spark, sf_dir), rel.match_sentiment(spark, sf_dir)
    first = rel.ranking(spark, sf_dir, fans).filter("rank = 1 AND is_rivalry")
    links = rel.link_sums(spark, sf_dir).agg(F.coalesce(F.sum("comments"), F.lit(0)).alias("n"))
    counted = (("matches", matches), ("matches with rivalry", matches.filter("is_rivalry")), ("links", links), ("goal_events", rel.goal_events(spark, sf_dir)), ("match_sentiment", fans), ("ranking first is rivalry", first))
    return reduce(DataFrame.unionByName, ((df if name == "links" else df.agg(F.count("*").alias("n"))).select(F.lit(name).alias("name"), "n") for name, df in counted))


QUERIES = {n: spark_query(n) for n in SQL} | {f.__name__: f for f in (daily_mean, comment_curve, gen1_social, table_counts)}
ORACLES = {n: oracle(n) for n in SQL}
