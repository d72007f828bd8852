import json

from turnstile import cli


def test_pipeline_over_files(spark, tmp_path):
    (tmp_path / "matches" / "11").mkdir(parents=True)
    (tmp_path / "events").mkdir()
    (tmp_path / "items").mkdir()
    (tmp_path / "competitions.json").write_text(json.dumps([{"competition_id": 11, "season_id": 90, "competition_name": "Liga", "season_name": "2020"}]))
    (tmp_path / "matches" / "11" / "90.json").write_text(json.dumps([{"match_id": 7, "home_team": {"home_team_name": "Real Madrid"}, "away_team": {"away_team_name": "Barcelona"}, "match_date": "2020-10-24", "home_score": 3, "away_score": 1}]))
    (tmp_path / "events" / "7.json").write_text(json.dumps([{"minute": 5, "shot": {"outcome": {"name": "Goal"}}}]))
    rows = [{"source": "s", "external_id": f"{i:03}", "comment": "great madrid beat barca", "upvotes": i, "posted_at": 1} for i in range(5)]
    (tmp_path / "items" / "x.json").write_text("\n".join(map(json.dumps, [*rows, rows[0], {"source": "s", "external_id": "z", "comment": "[deleted]"}])))
    got = cli.run_pipeline(spark, str(tmp_path), str(tmp_path / "out"))
    assert (got["matches"], got["goals"], got["items"], got["linked"], got["fan_sentiment_score"]) == (1, 1, 5, 5, 1.0)
    assert cli.run_pipeline(spark, str(tmp_path), None, skip_comments=True, skip_fixtures=True)["items"] == 0


def test_a_failing_phase_scores_minus_one(spark):
    assert cli.evaluate(2, {})["composite"] == -1.0
