import threading

import pytest
from pyspark.sql import functions as F

from turnstile.operators import evaluation, segments


@pytest.fixture(scope="module")
def points(spark):
    rows = [(f"a{i}", float(i % 4 * 100 + i // 4), float(i % 4 * 50)) for i in range(40)]
    return spark.createDataFrame(rows, "author string, x double, y double").withColumn("truth", F.substring("author", 2, 9).cast("int") % 4)


@pytest.mark.parametrize("kind", ["kmeans", "gmm_diag", "gmm_tied", "gmm_spherical", "agglomerative"])
def test_clusterers_find_separate_groups(points, kind):
    out = segments.cluster(points, "author", ["x", "y"], 4, kind)
    assert segments.adjusted_rand(out, "truth", "cluster").first()[0] > (0.99 if kind in ("kmeans", "agglomerative") else 0.5)


def test_ari_and_silhouette(points):
    assert segments.adjusted_rand(points, "truth", "truth").first()[0] == 1.0
    good = points.withColumn("v", F.array("x", "y"))
    assert segments.silhouette(good, "author", "v", "truth", block_rows=7).first()[0] > 0.8


def test_scalers(points):
    got = segments.scale(points, ["x"], "robust").agg(F.percentile("x_scaled", F.lit(0.5))).first()[0]
    assert abs(got) < 1e-12
    flat = segments.scale(points.withColumn("x", F.lit(1.0)), ["x"], "standard").agg(F.max(F.abs("x_scaled"))).first()[0]
    assert flat == 0.0


def test_ratchet(tmp_path):
    r = evaluation.Ratchet(str(tmp_path / "s.json"), target=0.9, patience=2)
    assert [r.offer({}, v) for v in (0.5, 0.5, 0.6)] == [True, False, True]
    state = evaluation.grid_search([{"v": v} for v in (0.1, 0.2, 0.95)], lambda c: c["v"], r)
    assert state["best"] == 0.6 and r.exit_code() == 4


def test_mean_of_an_author_that_falls_on_a_tie(spark):
    """Sums of these doubles miss the mean by a bit in whatever order they come."""
    rows = spark.range(64).selectExpr("'a' AS author", "'s' AS subreddit", "id AS match_id", "1 AS score", "IF(id < 3, 0.98D, 0.8D) AS sentiment")
    assert segments.author_features(rows).first().avg_sentiment == 0.8084375


def test_restarts_run_side_by_side_on_few_pieces(points, monkeypatch):
    """The ten fits start before the first one ends, and forty points are one piece of work, not one for each partition."""
    seen = []

    class Fit:
        def __init__(self, seed, **_):
            self.seed = seed

        def fit(self, data):
            seen.append((self.seed, data.rdd.getNumPartitions()))
            ready.wait(60)
            return self

        def transform(self, df):
            return df.withColumn("cluster", F.lit(self.seed))

        summary = property(lambda self: type("Summary", (), {"trainingCost": abs(self.seed - 43)}))

    ready = threading.Barrier(2)
    monkeypatch.setattr(segments, "KMeans", Fit)
    assert {r.cluster for r in segments.kmeans(points.repartition(16), ["x", "y"], 4).collect()} == {43}
    assert sorted(seen) == [(seed, 1) for seed in range(42, 52)]


def test_silhouette_in_a_grid_of_cells(points, monkeypatch):
    """The same value whatever the cells and blocks, one row a point, cluster and column of cells between them."""
    v = points.withColumn("v", F.array("x", "y"))
    want = segments.silhouette(v, "author", "v", "truth").first()[0]
    monkeypatch.setattr(segments, "CELL_ROWS", 9)
    got = segments.silhouette(v, "author", "v", "truth", block_rows=3)
    assert got.first()[0] == pytest.approx(want, abs=1e-12)
    assert "Cartesian" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
