"""The queries over links see the whole window of 48 hours, not only the operator by itself."""

import oracle
from pyspark.sql import functions as F

from turnstile.operators import linking
from turnstile.operators.linking import LinkerOptions
from turnstile.plans import relations as rel

SF = "/root/testdata/sf0.001"
HOURS = 48


def test_linked_queries_use_the_whole_window(spark):
    comments, fixtures = rel.comments(spark, SF), rel.matches(spark, SF)
    want = linking.link(comments, fixtures, rel.CONFIG, LinkerOptions(before_hours=HOURS, after_hours=HOURS)).select("match_id", "comment_id")
    got = rel.links(spark, SF).select("match_id", "comment_id").persist()
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    far = F.abs(F.col("minutes_from_kickoff"))
    assert rel.links(spark, SF).filter((far > HOURS * 30) & (far <= HOURS * 60)).count() > 0


def test_the_oracle_band_is_the_whole_window():
    con = oracle.connect(SF)
    sql = rel.with_ctes("SELECT min(minutes_from_kickoff), max(minutes_from_kickoff) FROM evidence", "links")
    low, high = con.execute(sql).fetchone()
    assert -HOURS * 60 <= low < -HOURS * 30 and HOURS * 30 < high <= HOURS * 60
