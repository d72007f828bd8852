import pytest
from pyspark.sql import functions as F

from turnstile.operators import linking
from turnstile.operators.linking import LinkerOptions, LinkingConfig

CONFIG = LinkingConfig.from_dict(
    {
        "teams": {
            "Barcelona": {"aliases": ["barcelona", "barca"], "home_subreddits": ["barca"]},
            "Real Madrid": {"aliases": ["real madrid"], "home_subreddits": ["realmadrid"]},
            "Atletico Madrid": {"aliases": ["rojiblancos"]},
            "Athletic Bilbao": {"aliases": ["rojiblancos"]},
            "Nobody": {"aliases": []},
        },
        "rivalries": {"a": {"teams": ["Barcelona", "Real Madrid"], "keywords": ["clasico", "el clasico"]}, "b": {"teams": ["X", "Y"], "keywords": []}},
        "generic_football_subreddits": ["soccer"],
    }
)
EPOCH = 1603497600
CASES = [
    ("real madrid and barcelona tonight", "soccer", 0.70, "both_teams_mentioned;generic_football_subreddit"),
    ("barcelona real madrid", "other", 0.60, "both_teams_mentioned"),
    ("what a day for it", "barca", 0.60, "home_mentioned;team_home_subreddit"),
    ("what a day for it", "realmadrid", 0.60, "away_mentioned;team_home_subreddit"),
    ("el clasico: barca vs real madrid", "barca", 1.00, "both_teams_mentioned;rivalry_keyword;team_home_subreddit"),
    ("clasico barca real madrid", "soccer", 0.95, "both_teams_mentioned;rivalry_keyword;generic_football_subreddit"),
    ("barca", "soccer", 0.45, "home_mentioned;generic_football_subreddit"),
    ("barca", "other", None, None),
    ("el clasico", "soccer", None, None),
    ("really good", "other", None, None),
    ("barcaé real madrid", "other", None, None),
    ("el clásico", "soccer", None, None),
    (None, "other", None, None),
]


@pytest.fixture(scope="module")
def fixtures(spark):
    return spark.createDataFrame([(1, "Barcelona", "Real Madrid", EPOCH)], "match_id long, home_team string, away_team string, match_epoch long")


def test_confidence(spark, fixtures):
    rows = [(str(i), b, s, EPOCH) for i, (b, s, _, _) in enumerate(CASES)]
    got = {r.comment_id: (r.link_confidence, r.link_reasons) for r in linking.link(spark.createDataFrame(rows, "id string, body string, subreddit string, created_utc long"), fixtures, CONFIG).collect()}
    assert got == {str(i): (c, r) for i, (_, _, c, r) in enumerate(CASES) if c is not None}


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_window_is_closed(spark, fixtures, broadcast_rows):
    at = [EPOCH - 172801, EPOCH - 172800, EPOCH + 172800, EPOCH + 172801]
    rows = spark.createDataFrame([(str(t), "barcelona real madrid", "other", t) for t in at], "id string, body string, subreddit string, created_utc long")
    got = linking.link(rows, fixtures, CONFIG, LinkerOptions(broadcast_rows=broadcast_rows)).select("comment_id").collect()
    assert sorted(r[0] for r in got) == [str(at[1]), str(at[2])]


@pytest.mark.parametrize("strategy", ["broadcast", "bucket"])
def test_band_join(spark, strategy):
    points = spark.createDataFrame([(t,) for t in (-11, -10, 0, 7, 8, 100)], "at long")
    got = linking.band_join(points, spark.createDataFrame([(0,), (92,)], "centre long"), "at", "centre", 10, 7, strategy).collect()
    assert sorted(map(tuple, got)) == [(-10, 0), (0, 0), (7, 0)]


def test_a_pair_found_by_several_keys_is_one_link(spark):
    teams = [("Barcelona", "Real Madrid"), ("Barcelona", "Barcelona"), (None, "Barcelona"), ("Real Madrid", "Barcelona")]
    fixtures = spark.createDataFrame([(i, h, a, EPOCH) for i, (h, a) in enumerate(teams)], "match_id long, home_team string, away_team string, match_epoch long")
    rows = spark.createDataFrame([("x", "el clasico: barca vs real madrid", "barca", EPOCH)], "id string, body string, subreddit string, created_utc long")
    got = linking.link(rows, fixtures, CONFIG)
    assert sorted((r.match_id, r.link_confidence) for r in got.collect()) == [(0, 1.0), (1, 0.85), (2, 0.6), (3, 1.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_shared_alias(spark):
    df = spark.createDataFrame([("rojiblancos", "x")], "body string, subreddit string")
    assert sorted(df.select(linking.detect_teams(F.col("body"), F.col("subreddit"), CONFIG)).first()[0]) == ["Athletic Bilbao", "Atletico Madrid"]


def test_first_match_takes_the_first_fixture_and_substrings(spark):
    fixtures = spark.createDataFrame([(1, 10, "Real United", "Inter City"), (2, 20, "Real United", "Inter City")], "ordinal long, match_id long, home_team string, away_team string")
    items = spark.createDataFrame([("a", "reunited with intercity"), ("b", "nothing"), ("c", None)], "external_id string, comment string")
    assert {r.external_id: r.match_id for r in linking.first_match(items, fixtures).collect()} == {"a": 10, "b": None, "c": None}


def test_no_python_in_the_linker_plan(spark, fixtures):
    rows = spark.createDataFrame([("1", "barca", "soccer", EPOCH)], "id string, body string, subreddit string, created_utc long")
    plan = linking.link(rows, fixtures, CONFIG)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

def test_first_match_is_sent_by_pairs_of_teams(spark):
    """Of 5,000 fixtures of two pairs the first of each pair is looked at, the lowest match_id at the same ordinal."""
    fixtures = spark.range(5_000).selectExpr("id % 50 AS ordinal", "id AS match_id", "IF(id % 50 < 7, 'Real United', 'Lower Valley') AS home_team", "'Inter City' AS away_team")
    items = spark.createDataFrame([("a", "lower intercity"), ("b", "united and inter"), ("c", "united in the valley with inter"), ("d", "lower")], "external_id string, comment string")
    out = linking.first_match(items, fixtures)
    assert {r.external_id: r.match_id for r in out.collect()} == {"a": 7, "b": 0, "c": 0, "d": None}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
