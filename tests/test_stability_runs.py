"""The registered stability query runs all ten subsamples."""

from pyspark.sql import functions as F

from turnstile.operators import segments
from turnstile.plans import domain


def test_cluster_stability_query_has_ten_runs(spark, monkeypatch):
    rows = [(f"a{i}", float(i), float(i % 7), float(i % 5)) for i in range(40)]
    points = spark.createDataFrame(rows, "author string, comment_frequency double, sentiment_volatility double, engagement_activity double")
    monkeypatch.setattr(domain, "_points", lambda spark, sf_dir: points)
    monkeypatch.setattr(segments, "cluster", lambda df, key, columns, k, *rest: df.withColumn("cluster", F.pmod(F.xxhash64(key), F.lit(k))))
    assert sorted(r.run for r in domain.cluster_stability(spark, "").collect()) == list(range(10))
