"""Streams against the same operators over tables, and small operators beside them."""

import logging

from pyspark.sql import functions as F

from turnstile.operators import evaluation, linking, merge
from turnstile.plans import relations as rel
from turnstile.streaming import ingest

SF = "/root/testdata/sf0.001"


def _streamed(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _landed(spark, tmp_path):
    rows = rel.comments(spark, SF)
    rows.repartition(3).write.parquet(str(tmp_path / "comments"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "comments"))


def test_linked_stream_equals_the_table(spark, tmp_path):
    rows, stream = _landed(spark, tmp_path)
    fixtures = rel.matches(spark, SF)
    got = _streamed(spark, ingest.linked(stream, fixtures, rel.CONFIG), "linked")
    want = linking.link(rows, fixtures, rel.CONFIG)
    assert want.count() == got.count() > 0 and want.exceptAll(got).count() == 0


def test_tumbling_counts_and_duplicates(spark, tmp_path):
    rows, stream = _landed(spark, tmp_path)
    q = ingest.tumbling_counts(stream, late="4000 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    want = ingest.tumbling_counts(rows)
    got = spark.table("tumbling")
    assert want.select("start", "subreddit", "comments").exceptAll(got.select("start", "subreddit", "comments")).count() == 0 and want.count() == got.count()
    twice = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "*"))
    rows.write.mode("append").parquet(str(tmp_path / "comments"))
    assert _streamed(spark, ingest.deduplicated(twice, "4000 days"), "once").count() == rows.select("id").distinct().count()


def test_new_rows_are_counted(spark):
    target, source = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, merge.new_rows(target, source, ["id"]).collect())) == [(2, "b")]


def test_score_override_falls_back(spark):
    scores = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.5)], "match_id long, s double")
    flags = spark.createDataFrame([(1, False), (2, True), (3, False)], "match_id long, is_rivalry boolean")
    override = spark.createDataFrame([(2, 1.0), (3, None), (9, 0.0)], "match_id long, score double")
    assert evaluation.rivalry_metrics(scores, flags, "s").first().auc == 0.0
    assert evaluation.rivalry_metrics(scores, flags, "s", override).first().auc == 1.0


def test_low_coverage_is_logged(spark, caplog):
    links, comments = spark.range(10).select(F.col("id").alias("comment_id")), spark.range(9)
    with caplog.at_level(logging.WARNING):
        assert linking.coverage(links, comments) == 0.9 and "90.0" in caplog.text
    assert linking.coverage(links.limit(0), comments) == 1.0
