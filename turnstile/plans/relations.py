"""The domain relations as projections of the driver's tables, as DataFrames and as DuckDB common table expressions.

Both sides are deterministic and typed alike.  Fixtures are every hundredth event, their teams nations; comments are
events; goals are line items; the football side comes from orders.  See README.md for the mapping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.operators import grouped, linking, metrics
from turnstile.operators.linking import LinkerOptions, LinkingConfig, Rivalry, Team

N_TEAMS = 25
#: Home communities of the first teams; the last two communities are generic as well.
COMMUNITIES = ("click", "error", "purchase", "signup", "view")
GENERIC = ("click", "view")
KEYWORD = "derby"
CONFIG = LinkingConfig(
    tuple(Team(f"NATION_{i}", (f"nation_{i}",), (COMMUNITIES[i],) if i < len(COMMUNITIES) else ()) for i in range(N_TEAMS)),
    tuple(Rivalry((f"NATION_{i}", f"NATION_{j}"), (KEYWORD,)) for i in range(N_TEAMS) for j in range(i + 1, N_TEAMS) if (j - i) % 5 == 0),
    GENERIC,
)
#: The operator's own window, 48 hours to each side, in every query over links; the DuckDB band follows it.
LINK = LinkerOptions()
SEGMENTS = ((40, "Casual Fan"), (60, "Tactical Fan"), (80, "Highly Engaged Fan"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A bare scan, dealt out evenly if it comes in fewer pieces than there are cores: texts are dear to search."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def epoch(ts) -> F.Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"))
    k = F.get_json_object("props", "$.k").cast("int")
    team = lambda x: F.concat(F.lit("nation_"), (x % N_TEAMS).cast("string"))
    body = F.concat(F.when(F.col("event_id") % 2 == 0, F.concat(team(F.col("user_id")), F.lit(" plays "))).otherwise(F.lit("they play ")), team(k), F.when(k % 10 == 0, f" {KEYWORD}").otherwise(""))
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), epoch("ts").alias("created_utc"), F.col("event_type").alias("subreddit"), k.alias("score"), ((k - 50) / F.lit(50.0)).alias("sentiment"), body.alias("body"))


COMMENTS = f"""comments AS (
  SELECT event_id AS id, 'u' || user_id AS author, CAST(floor(epoch(ts)) AS BIGINT) AS created_utc, event_type AS subreddit, k AS score, (k - 50) / 50.0::DOUBLE AS sentiment,
    CASE WHEN event_id % 2 = 0 THEN 'nation_' || (user_id % {N_TEAMS}) || ' plays ' ELSE 'they play ' END || 'nation_' || (k % {N_TEAMS}) || CASE WHEN k % 10 = 0 THEN ' {KEYWORD}' ELSE '' END AS body
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_id % 100 = 0").select("event_id", "ts", "value", F.expr("event_id div 100").alias("f"))
    h = F.col("f") % N_TEAMS
    rows = e.select(F.col("event_id").alias("match_id"), "ts", "value", "f", h.alias("h"), ((h + 1 + (F.col("f") * 7) % (N_TEAMS - 1)) % N_TEAMS).alias("a"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), "n_name", "n_regionkey")
    side = lambda p: n.select(F.col("key").alias(f"{p}k"), F.col("n_name").alias(f"{p}n"), F.col("n_regionkey").alias(f"{p}r"))
    rows = rows.join(side("h"), F.col("h") == F.col("hk")).join(side("a"), F.col("a") == F.col("ak"))
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    home, away = (F.floor("value") % 5).cast("int"), (F.floor(F.col("value") / 5) % 4).cast("int")
    return rows.select("match_id", F.col("hn").alias("home_team"), F.col("an").alias("away_team"), F.concat(F.lit("C"), (F.col("f") % 3).cast("string")).alias("competition"), F.col("ts").cast("date").alias("match_date"), F.unix_timestamp(day).alias("match_epoch"), home.alias("home_score"), away.alias("away_score"), (F.col("hr") == F.col("ar")).alias("is_rivalry"), (home + away).alias("total_goals"))


MATCHES = f"""matches AS (
  SELECT event_id AS match_id, nh.n_name AS home_team, na.n_name AS away_team, 'C' || (f % 3) AS competition, CAST(ts AS DATE) AS match_date, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS match_epoch,
    hs AS home_score, aw AS away_score, nh.n_regionkey = na.n_regionkey AS is_rivalry, hs + aw AS total_goals
  FROM (SELECT *, CAST(floor(value) AS BIGINT) % 5 AS hs0, CAST(CAST(floor(value) AS BIGINT) % 5 AS INTEGER) AS hs, CAST(CAST(floor(value / 5) AS BIGINT) % 4 AS INTEGER) AS aw,
      f % {N_TEAMS} AS h, (f % {N_TEAMS} + 1 + (f * 7) % {N_TEAMS - 1}) % {N_TEAMS} AS a FROM (SELECT *, event_id // 100 AS f FROM events WHERE event_id % 100 = 0))
  JOIN nation nh ON nh.n_nationkey = h JOIN nation na ON na.n_nationkey = a)"""


def goal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").filter("event_id % 100 = 0").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount").crossJoin(F.broadcast(n)).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select((F.col("l_orderkey") % F.col("n") * 100).alias("match_id"), (F.col("l_linenumber") * 13).alias("minute"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("team"), F.col("s_name").alias("player"), (F.col("l_discount") * 10 + 0.0).alias("xg"))


GOALS = """goal_events AS (
  SELECT l_orderkey % (SELECT count(*) FROM events WHERE event_id % 100 = 0) * 100 AS match_id, l_linenumber * 13 AS minute, 'NATION_' || s_nationkey AS team, s_name AS player, l_discount * 10 + 0.0 AS xg
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""


def links(spark: SparkSession, sf_dir: str, options: LinkerOptions = LINK) -> DataFrame:
    return linking.link(comments(spark, sf_dir), matches(spark, sf_dir), CONFIG, options)


def _has(alias: str) -> str:
    return f"regexp_matches(body, '(^|[^\\p{{L}}\\p{{N}}_]){alias}($|[^\\p{{L}}\\p{{N}}_])')"


_TEAMS_HIT = ", ".join(f"CASE WHEN {_has(t.aliases[0])}" + (f" OR subreddit = '{t.communities[0]}'" if t.communities else "") + f" THEN '{t.name}' END" for t in CONFIG.teams)
_HOME_OF = " ".join(f"WHEN 'NATION_{i}' THEN '{c}'" for i, c in enumerate(COMMUNITIES))
LINKS = f"""seen AS (SELECT *, list_filter([{_TEAMS_HIT}], lambda x: x IS NOT NULL) AS hit, {_has(KEYWORD)} AS word FROM comments),
evidence AS (
  SELECT m.match_id, s.id AS comment_id, s.subreddit, s.created_utc, m.match_epoch, (s.created_utc - m.match_epoch) / 60.0::DOUBLE AS minutes_from_kickoff,
    list_contains(hit, home_team) AS h, list_contains(hit, away_team) AS a, word AND is_rivalry AS r,
    coalesce(subreddit = CASE home_team {_HOME_OF} END, false) OR coalesce(subreddit = CASE away_team {_HOME_OF} END, false) AS hc, subreddit IN ('click', 'view') AS g
  FROM seen s JOIN matches m ON s.created_utc BETWEEN m.match_epoch - {int(LINK.before_hours * 3600)} AND m.match_epoch + {int(LINK.after_hours * 3600)}),
links AS (
  SELECT match_id, comment_id, subreddit, created_utc, match_epoch, minutes_from_kickoff, link_reasons, round(raw, 3) AS link_confidence FROM (
    SELECT *, least(CASE WHEN h AND a THEN 0.6::DOUBLE WHEN h OR a THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN r THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN hc THEN 0.25::DOUBLE WHEN g THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) AS raw,
      concat_ws(';', CASE WHEN h AND a THEN 'both_teams_mentioned' WHEN h THEN 'home_mentioned' WHEN a THEN 'away_mentioned' END, CASE WHEN r THEN 'rivalry_keyword' END, CASE WHEN hc THEN 'team_home_subreddit' WHEN g THEN 'generic_football_subreddit' END) AS link_reasons
    FROM evidence WHERE h OR a OR r) WHERE raw >= 0.4)"""


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the comment's columns; labels by integer score, as the thresholds fall on exact values of k."""
    c = comments(spark, sf_dir).select(F.col("id").alias("comment_id"), "author", "body", "score", "sentiment")
    label = F.when(F.col("score") >= 53, "positive").when(F.col("score") <= 47, "negative").otherwise("neutral")
    return links(spark, sf_dir).join(c, "comment_id").withColumn("sentiment_label", label)


def link_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a fixture with links: their number, scores and labels, as sums over enriched() would give them."""
    score = F.col("score")
    made = {"comments": F.count("*"), "upvotes": F.sum(score), "positive": F.count_if(score >= 53), "negative": F.count_if(score <= 47)}
    return grouped.fixture_sums(comments(spark, sf_dir), matches(spark, sf_dir), CONFIG, LINK, made)


ENRICHED = "enriched AS (SELECT l.*, c.author, c.body, c.score, c.sentiment, CASE WHEN c.score >= 53 THEN 'positive' WHEN c.score <= 47 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM links l JOIN comments c ON c.id = l.comment_id)"


def match_features(spark: SparkSession, sf_dir: str, mode: str = "mean") -> DataFrame:
    return grouped.match_features(comments(spark, sf_dir), matches(spark, sf_dir), CONFIG, LINK, mode)


FEATURES = """match_features AS (
  SELECT f.*, p.peak_hour_count FROM (
    SELECT match_id, count(*) AS comment_count, sum(link_confidence) AS weighted_comment_count, avg(sentiment) AS avg_sentiment, stddev_pop(sentiment) AS sentiment_volatility,
      avg(CASE WHEN score >= 55 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS positive_ratio, avg(CASE WHEN score <= 45 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS negative_ratio, count(DISTINCT subreddit) AS unique_subreddits
    FROM enriched GROUP BY match_id) f
  JOIN (SELECT match_id, max(n) AS peak_hour_count FROM (SELECT match_id, created_utc // 3600 AS hour, count(*) AS n FROM enriched GROUP BY ALL) GROUP BY match_id) p USING (match_id))"""


def match_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compute_engagement_score(match_features(spark, sf_dir))


def _norm(x: str, out: str) -> str:
    return f"CASE WHEN max({x}) OVER () - min({x}) OVER () < 1e-12 THEN 0.0::DOUBLE ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END AS {out}"


SENTIMENT = f"""match_sentiment AS (
  SELECT *, greatest(least(0.45 * volume_norm + 0.2 * affect_norm + 0.25 * volatility_norm + 0.1 * reach_norm, 1.0), 0.0)::DOUBLE AS engagement_score FROM (
    SELECT *, {_norm("ln(1 + weighted_comment_count)", "volume_norm")}, {_norm("abs(avg_sentiment)", "affect_norm")}, {_norm("sentiment_volatility", "volatility_norm")}, {_norm("ln(1 + unique_subreddits)", "reach_norm")} FROM match_features))"""


def football(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A football-side score a fixture: the mean of ten orders' prices, in thousands."""
    n = table(spark, sf_dir, "events").filter("event_id % 100 = 0").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(n))
    return o.groupBy((F.col("o_orderkey") % F.col("n") * 100).alias("match_id")).agg((F.round(F.avg("o_totalprice"), 2) / 1000).alias("engagement_score"))


FOOTBALL = "football AS (SELECT o_orderkey % (SELECT count(*) FROM events WHERE event_id % 100 = 0) * 100 AS match_id, round(avg(o_totalprice), 2) / 1000 AS engagement_score FROM orders GROUP BY 1)"


def combined(spark: SparkSession, sf_dir: str, fans: DataFrame | None = None) -> DataFrame:
    own = matches(spark, sf_dir).select("match_id").join(football(spark, sf_dir), "match_id", "left")
    return metrics.join_with_stage2(match_sentiment(spark, sf_dir) if fans is None else fans, own)


COMBINED = f"""combined AS (
  SELECT b.match_id, raw AS engagement_score_football_raw, norm AS engagement_score_football_norm, coalesce(s.engagement_score, 0.0)::DOUBLE AS engagement_score_fans, coalesce(s.comment_count, 0) AS fan_comment_count,
    s.avg_sentiment AS fan_avg_sentiment, s.sentiment_volatility AS fan_sentiment_volatility, greatest(least(0.35 * norm + 0.65 * coalesce(s.engagement_score, 0.0), 1.0), 0.0)::DOUBLE AS engagement_score_combined
  FROM (SELECT match_id, raw, {_norm("raw", "norm")} FROM (SELECT m.match_id, coalesce(f.engagement_score, 0.0)::DOUBLE AS raw FROM matches m LEFT JOIN football f USING (match_id))) b LEFT JOIN match_sentiment s USING (match_id))"""


def ranking(spark: SparkSession, sf_dir: str, fans: DataFrame | None = None) -> DataFrame:
    return metrics.ranking(combined(spark, sf_dir, fans), matches(spark, sf_dir))


#: Scores are compared at nine digits, so that the order does not hang on the last bits of a sum.
RANKING = "ranking AS (SELECT c.*, m.* EXCLUDE (match_id), CAST(home_score AS VARCHAR) || '-' || CAST(away_score AS VARCHAR) AS score_str, row_number() OVER (ORDER BY engagement_score_combined DESC NULLS LAST, c.match_id) AS rank FROM combined c JOIN matches m USING (match_id))"


def fan_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author features with a rule in place of clusters: by mean score of the author's comments."""
    f = grouped.author_features(comments(spark, sf_dir), matches(spark, sf_dir), CONFIG, LINK)
    mean = F.col("engagement_activity") / F.col("comment_frequency")
    segment = reduce(lambda acc, s: F.when(mean < s[0], s[1]).otherwise(acc), reversed(SEGMENTS), F.lit("Ultra Fan"))
    return f.withColumn("segment", segment)


FAN_SEGMENTS = f"""author_features AS (
  SELECT f.*, p.primary_subreddit FROM (
    SELECT author, count(*) AS comment_frequency, avg(sentiment) AS avg_sentiment, coalesce(stddev_samp(sentiment), 0.0)::DOUBLE AS sentiment_volatility, coalesce(sum(score), 0)::DOUBLE AS engagement_activity,
      count(DISTINCT match_id) AS matches_covered, avg(CASE WHEN score >= 55 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS positive_ratio FROM enriched GROUP BY author HAVING count(*) >= 3) f
  JOIN (SELECT author, arg_min(subreddit, (-n, subreddit)) AS primary_subreddit FROM (SELECT author, subreddit, count(*) AS n FROM enriched GROUP BY ALL) GROUP BY author) p USING (author)),
fan_segments AS (SELECT *, CASE {" ".join(f"WHEN engagement_activity / comment_frequency < {s} THEN '{n}'" for s, n in SEGMENTS)} ELSE 'Ultra Fan' END AS segment FROM author_features)"""

#: Common table expressions and what each needs before it.
CTES = {
    "comments": (COMMENTS, ()),
    "matches": (MATCHES, ()),
    "goal_events": (GOALS, ()),
    "football": (FOOTBALL, ()),
    "links": (LINKS, ("comments", "matches")),
    "enriched": (ENRICHED, ("links", "comments")),
    "match_features": (FEATURES, ("enriched",)),
    "match_sentiment": (SENTIMENT, ("match_features",)),
    "combined": (COMBINED, ("matches", "football", "match_sentiment")),
    "ranking": (RANKING, ("combined", "matches")),
    "fan_segments": (FAN_SEGMENTS, ("enriched",)),
}

FRAMES = {"comments": comments, "matches": matches, "goal_events": goal_events, "football": football, "links": links, "enriched": enriched, "match_features": match_features, "match_sentiment": match_sentiment, "combined": combined, "ranking": ranking, "fan_segments": fan_segments}


def with_ctes(sql: str, *names: str) -> str:
    """sql behind the named expressions and all they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for need in CTES[n][1]:
            visit(need)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(CTES[n][0] for n in order) + "\n" + sql if order else sql
