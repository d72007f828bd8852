import json

import zstandard

from turnstile.operators import merge
from turnstile.sources import archive, fixtures
from turnstile.streaming import ingest

LINES = [
    {"id": "a", "author": "x", "body": "b" * 15, "created_utc": "1600000000", "subreddit": "Barca", "score": 3.7, "link_id": "t"},
    {"id": "b", "body": "b" * 14, "created_utc": 1600000000, "subreddit": "barca"},
    {"id": "c", "body": "b" * 20, "created_utc": "1600.5", "subreddit": "barca"},
    {"id": "d", "author": None, "body": "b" * 20, "created_utc": 1600000001, "subreddit": "barca", "score": "x"},
    {"id": "e", "body": "b" * 20, "created_utc": 1600000001, "subreddit": "other", "score": "4"},
    {"id": None, "body": "b" * 20, "created_utc": 1600000001, "subreddit": "barca"},
]


def _write(folder):
    text = "\n".join(map(json.dumps, LINES)) + "\n{broken\n\n"
    (folder / "x.jsonl").write_text(text)
    return text


def test_archive_plain_and_zstd(spark, tmp_path):
    for kind in ("plain", "zst"):
        d = tmp_path / kind / "deep"
        d.mkdir(parents=True)
        text = _write(d)
        if kind == "zst":
            (d / "x.jsonl").unlink()
            (d / "x.zst").write_bytes(zstandard.compress(text.encode()))
        rows = archive.ArchiveSource(str(tmp_path / kind), archive.ArchiveOptions(subreddits=("barca",))).read(spark).orderBy("id").collect()
        assert [(r.id, r.author, r.subreddit, r.score) for r in rows] == [("a", "x", "barca", 3), ("d", "[deleted]", "barca", 0)]


def test_materialize_and_range(spark, tmp_path):
    _write(tmp_path)
    options = archive.ArchiveOptions(start="2020-09-13", end="2020-09-14")
    assert archive.ArchiveSource(str(tmp_path), options).materialize(spark, str(tmp_path / "out")) == 3


def test_stream_to_keyed_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in")
    source = archive.ArchiveSource(str(tmp_path / "in"))
    for _ in range(2):
        ingest.keyed_sink(source.stream(spark), str(tmp_path / "t"), ["id"], str(tmp_path / "c")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "d", "e"]


def test_fixtures_and_goals(spark, tmp_path):
    d = tmp_path / "matches" / "11"
    d.mkdir(parents=True)
    (d / "90.json").write_text(json.dumps([{"match_id": 7, "home_team": {"home_team_name": "Real Madrid"}, "away_team": {"away_team_name": "Barcelona"}, "match_date": "2020-10-24", "home_score": 3, "away_score": None}]))
    competition = spark.createDataFrame([(11, 90, "Liga", "2020")], fixtures.COMPETITIONS)
    r = fixtures.fixtures(spark, str(tmp_path / "matches" / "*"), competition, [11]).first()
    assert (r.match_id, r.is_rivalry, r.total_goals, r.competition, str(r.match_date)) == (7, True, 3, "Liga", "2020-10-24")
    assert fixtures.fixtures(spark, str(tmp_path / "matches" / "*"), competition, [12]).count() == 0
    e = tmp_path / "events"
    e.mkdir()
    (e / "7.json").write_text(json.dumps([{"minute": 3}, {"minute": 5, "shot": {"outcome": {"name": "Goal"}, "statsbomb_xg": 0.5}}, {"minute": 6, "shot": {"outcome": {"name": "Saved"}}}]))
    assert [tuple(x) for x in fixtures.goal_events(spark, str(e)).collect()] == [(7, 5, None, None, 0.5)]


def test_merges(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, merge.upsert(t, s, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, merge.insert_ignore(t, s, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "e")]
