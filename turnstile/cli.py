"""Command lines: run the gen-1 pipeline over landed files, or score one evaluation phase; both print JSON."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.operators import evaluation, linking, metrics, segments, sentiment
from turnstile.sources import fixtures, tables

ITEMS = "source STRING, external_id STRING, comment STRING, upvotes INT, posted_at TIMESTAMP"


def run_pipeline(spark: SparkSession, data: str, out: str | None, skip_comments: bool = False, skip_fixtures: bool = False) -> dict:
    """Fixtures, goals and dropped items to indicators and segments; Parquet and CSV below out unless it is None.

    Skipped sources are empty frames with their full schema, so every later step still runs.
    """
    matches = spark.createDataFrame([], tables.SCHEMAS["matches"]) if skip_fixtures else fixtures.fixtures(spark, f"{data}/matches/*", fixtures.competitions(spark, f"{data}/competitions.json"))
    goals = spark.createDataFrame([], tables.SCHEMAS["goal_events"]) if skip_fixtures else fixtures.goal_events(spark, f"{data}/events")
    items = spark.createDataFrame([], ITEMS) if skip_comments else tables.live_items(spark, f"{data}/items")
    scored = sentiment.enrich(items)
    linked = linking.first_match(scored, matches.withColumn("ordinal", F.col("match_id")))
    kpis = metrics.build_engagement_metrics(matches, linked, fixtures.goals_per_match(goals))
    segmented = segments.segment_fans(scored)
    if out:
        for name, df in (("matches", matches), ("fan_sentiment", linked), ("engagement_metrics", kpis), ("fan_segments", segmented)):
            df.write.mode("overwrite").parquet(f"{out}/{name}")
            tables.write_csv(df, f"{out}/csv/{name}", single=True)
    headline = metrics.fan_sentiment_score(scored).first()[0]
    return {"matches": matches.count(), "goals": goals.count(), "items": items.count(), "linked": linked.filter("match_id IS NOT NULL").count(), "fan_sentiment_score": headline}


def evaluate(phase: int, inputs: dict[str, DataFrame]) -> dict:
    """Phase 1: clusters (silhouette, stability); phases 2 and 3: separation of rivalries by the combined score.

    inputs: features for phase 1; combined and matches for the others.  A failing phase has composite -1.
    """
    try:
        if phase == 1:
            columns = ["comment_frequency", "sentiment_volatility", "engagement_activity"]
            scaled = segments.scale(inputs["features"], columns)
            names = [f"{c}_scaled" for c in columns]
            clustered = segments.kmeans(scaled, names, 4).withColumn("v", F.array(*names))
            sil = segments.silhouette(clustered, "author", "v", "cluster").first()[0]
            stable = segments.cluster_stability(scaled, "author", names, 4).agg(F.avg("ari")).first()[0]
            return {"phase": 1, "silhouette": sil, "stability": stable, "composite": evaluation.phase1_composite(sil, stable)}
        row = evaluation.rivalry_metrics(inputs["combined"], inputs["matches"]).first().asDict()
        top = [r.match_id for r in evaluation.top_ranked(inputs["combined"], "engagement_score_combined").collect()]
        return {"phase": phase, **row, "top": top}
    except (ValueError, KeyError) as e:
        return {"phase": phase, "composite": -1.0, "error": str(e)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="turnstile")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    run.add_argument("--skip-comments", action="store_true")
    run.add_argument("--skip-fixtures", action="store_true")
    run.add_argument("--no-persist", action="store_true")
    check = sub.add_parser("evaluate")
    check.add_argument("--phase", type=int, choices=(1, 2, 3), required=True)
    check.add_argument("--data", required=True, help="folder with features, or combined and matches, as Parquet")
    check.add_argument("--baseline", help="JSON file that gets the result under the phase")
    a = p.parse_args(argv)
    from turnstile.session import local_session

    spark = local_session()
    if a.command == "run":
        result = run_pipeline(spark, a.data, None if a.no_persist else a.out, a.skip_comments, a.skip_fixtures)
    else:
        result = evaluate(a.phase, {n: spark.read.parquet(f"{a.data}/{n}") for n in (("features",) if a.phase == 1 else ("combined", "matches"))})
        if a.baseline:
            known = json.loads(Path(a.baseline).read_text()) if Path(a.baseline).exists() else {}
            Path(a.baseline).write_text(json.dumps(known | {str(a.phase): result}))
    print(json.dumps(result, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
