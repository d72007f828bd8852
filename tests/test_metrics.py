"""The published chain of scores, retyped: fan composite, blend, ranking, separation."""

import pytest
from pyspark.sql import functions as F

from turnstile.functions.exprs import mean
from turnstile.operators import evaluation, metrics

# match_id, rivalry, total goals, goal events, comments, weighted, mean, deviation, communities, fan score, combined, rank.
GOLDEN = [
    (3773585, True, 4, 4, 14866, 9094.7, 0.11693127943, 0.496193115999, 2, 0.680600899746, 0.59794614039, 1),
    (3773597, False, 7, 7, 7224, 4347.9, 0.206735105205, 0.476998891322, 2, 0.380210138544, 0.597136590054, 2),
    (3773387, False, 6, 6, 11383, 6829.8, 0.111017754546, 0.502207343097, 1, 0.499643383022, 0.558101532297, 3),
    (3773477, False, 7, 7, 6888, 4162.55, 0.119220920441, 0.486074887209, 2, 0.271904790871, 0.526738114066, 4),
    (3773497, True, 3, 3, 17089, 10491.9, 0.115222002458, 0.480960162445, 2, 0.609436283229, 0.435022472988, 5),
    (3773661, False, 7, 5, 9104, 5462.4, 0.119360874341, 0.50677108574, 1, 0.46003201193, 0.415687474421, 6),
    (3773526, False, 6, 6, 5986, 3591.6, 0.174033678583, 0.481015801707, 1, 0.171614827777, 0.344882971388, 7),
    (3773695, False, 5, 5, 7008, 4235.8, 0.101442879566, 0.497739424677, 2, 0.343406276353, 0.339880746296, 8),
    (3773369, False, 5, 5, 7284, 4370.4, 0.158847473915, 0.487660634964, 1, 0.280943015991, 0.299279627061, 9),
    (3773631, False, 5, 4, 6466, 3908.85, 0.156979647386, 0.480667341292, 2, 0.271823580898, 0.176685327584, 10),
]


@pytest.fixture(scope="module")
def golden(spark):
    names = "match_id long, is_rivalry boolean, total_goals int, goal_events int, comment_count long, weighted_comment_count double, avg_sentiment double, sentiment_volatility double, unique_subreddits long, fan double, combined double, rank long"
    return spark.createDataFrame(GOLDEN, names)


def test_chain(spark, golden):
    social = spark.createDataFrame([], "match_id long, upvotes int, sentiment_score double, sentiment_label string")
    football = metrics.build_engagement_metrics(golden.select("match_id", "is_rivalry"), social, golden.select("match_id", "goal_events")).select("match_id", "engagement_score")
    fans = metrics.compute_engagement_score(golden.select("match_id", "comment_count", "weighted_comment_count", "avg_sentiment", "sentiment_volatility", "unique_subreddits"))
    got = {r.match_id: r.engagement_score for r in fans.collect()}
    assert all(abs(got[g[0]] - g[9]) < 1e-9 for g in GOLDEN)
    combined = metrics.join_with_stage2(fans, football)
    got = {r.match_id: r.engagement_score_combined for r in combined.collect()}
    assert all(abs(got[g[0]] - g[10]) < 1e-9 for g in GOLDEN)
    meta = golden.select("match_id", "is_rivalry", F.lit(1).alias("home_score"), F.lit(2).alias("away_score"))
    assert [(r.match_id, r.rank) for r in metrics.ranking(combined, meta).orderBy("rank").collect()] == [(g[0], g[11]) for g in GOLDEN]
    auc, margin, norm, composite = (evaluation.rivalry_metrics(combined, meta).first()[c] for c in ("auc", "margin", "margin_norm", "composite"))
    assert (auc, round(norm, 6), round(composite, 6)) == (0.8125, 0.554593, 0.683546)


def test_spearman(golden):
    assert round(evaluation.spearman(golden, "combined", "total_goals").first()[0], 6) == 0.180756


def test_edges(spark, golden):
    one = golden.limit(1)
    assert {r.engagement_score for r in metrics.compute_engagement_score(one.drop("rank", "combined")).collect()} == {0.0}
    assert evaluation.roc_auc(golden.withColumn("y", F.lit(True)), "combined", "y").first()[0] == 0.5
    assert metrics.fan_sentiment_score(spark.createDataFrame([], "sentiment_label string")).first()[0] == 0.0
    with pytest.raises(ValueError):
        metrics.aggregate_per_match(golden, golden)


@pytest.mark.parametrize(("mode", "want"), [("mean", 0.25), ("median", 0.25), ("weighted_mean", 0.5)])
def test_affect_modes(spark, mode, want):
    links = spark.createDataFrame([(1, "a", 0.6, 0, "s"), (1, "b", 0.6, 0, "s"), (1, "c", 0.6, 0, "s")], "match_id long, comment_id string, link_confidence double, created_utc long, subreddit string")
    scored = spark.createDataFrame([("a", 0.5, 4), ("a", 0.5, 4), ("b", 0.0, -3), ("c", None, 1)], "id string, sentiment double, score int")
    assert metrics.aggregate_per_match(links, scored, mode).first().avg_sentiment == want


def test_mean_of_a_fixture_that_falls_on_a_tie(spark):
    """Sums of these doubles miss the mean by a bit in whatever order they come."""
    links = spark.range(64).selectExpr("1L AS match_id", "id AS comment_id", "0.6D AS link_confidence", "0L AS created_utc", "'s' AS subreddit")
    scored = spark.range(64).selectExpr("id", "IF(id < 3, 0.98D, 0.8D) AS sentiment", "0 AS score")
    for mode in ("mean", "weighted_mean"):
        assert metrics.aggregate_per_match(links, scored, mode).first().avg_sentiment == 0.8084375


def test_mean_out_of_range(spark):
    """Beyond the digits of the exact sum, and with NaN, the plain average stands; nulls do not count."""
    values = {"tiny": [1e-30, 3e-30], "huge": [1e300, 1e300], "sum": [9e9] * 100, "nan": [0.5, float("nan")], "null": [None, None], "some": [None, 0.1, 0.2], "zero": [0.0, -0.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = dict(df.groupBy("k").agg(mean(F.col("v"))).collect())
    assert got.pop("tiny") == pytest.approx(2e-30)
    assert str(got.pop("nan")) == "nan"
    assert got == {"huge": 1e300, "sum": 9e9, "null": None, "some": 0.15, "zero": 0.0}
