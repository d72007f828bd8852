"""Queries over single operators, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions.exprs import RATIO_BAND, mentions, polarity_label
from turnstile.operators import evaluation, linking, merge, metrics, segments, sentiment
from turnstile.plans import relations as rel
from turnstile.sources import archive, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Frequent words of the texts stand for teams in the text queries.
WORDS = ("that", "with", "from", "this", "which", "the", "and")
LEXICON = {"the": 0.5, "and": -0.4, "with": 1.25, "of": -0.75, "this": 2.0, "de": 0.3, "que": -1.1, "worthless": -2.5}
SHORTHAND = {"NATION_1": ["plays"]}


def query(oracle: str | None = None, *ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = rel.with_ctes(oracle, *ctes)
        return f

    return register


def _hit(word: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){word}($|[^\\p{{L}}\\p{{N}}_])')"


@query(f"SELECT team, count(*) AS documents FROM (SELECT unnest([{', '.join(f'CASE WHEN {_hit(w)} THEN {chr(39)}{w}{chr(39)} END' for w in WORDS)}]) AS team FROM documents) WHERE team IS NOT NULL GROUP BY team")
def team_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rel.table(spark, sf_dir, "documents")
    config = linking.LinkingConfig(tuple(linking.Team(w, (w,)) for w in WORDS))
    return docs.select(F.explode(linking.detect_teams(F.col("text"), F.col("source"), config)).alias("team")).groupBy("team").agg(F.count("*").alias("documents"))


@query(f"SELECT id, {rel._has('derby')} AS rivalry FROM comments", "comments")
def rivalry_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.comments(spark, sf_dir).select("id", (F.size(linking.detect_rivalries(F.col("body"), rel.CONFIG)) > 0).alias("rivalry"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.comments(spark, sf_dir).select(F.col("id").cast("string").alias("external_id"), F.col("body").alias("comment"), F.col("subreddit").alias("source"), F.col("score").alias("upvotes"), F.col("sentiment").alias("sentiment_score"))


ITEMS = "items AS (SELECT CAST(id AS VARCHAR) AS external_id, body AS comment, subreddit AS source, score AS upvotes, sentiment AS sentiment_score FROM comments)"
rel.CTES["items"] = (ITEMS, ("comments",))
FIRST = """kw AS (SELECT match_id, row_number() OVER (ORDER BY match_id) AS ordinal, home_team, away_team,
  list_concat(['nation'], CASE WHEN home_team = 'NATION_1' THEN ['plays'] ELSE [] END) AS h, list_concat(['nation'], CASE WHEN away_team = 'NATION_1' THEN ['plays'] ELSE [] END) AS a FROM matches),
hits AS (SELECT external_id, arg_min(match_id, ordinal) AS match_id FROM items, kw WHERE len(list_filter(h, lambda w: contains(lower(comment), w))) > 0 AND len(list_filter(a, lambda w: contains(lower(comment), w))) > 0 GROUP BY external_id)"""
rel.CTES["first_hits"] = (FIRST, ("items", "matches"))


@query("SELECT i.external_id, h.match_id FROM items i LEFT JOIN hits h USING (external_id)", "first_hits")
def link_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures = rel.matches(spark, sf_dir).withColumn("ordinal", F.col("match_id"))
    return linking.first_match(_items(spark, sf_dir), fixtures, SHORTHAND).select("external_id", "match_id")


def _social(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.enriched(spark, sf_dir).select("match_id", F.col("score").alias("upvotes"), F.col("sentiment").alias("sentiment_score"), "sentiment_label")


def _scaled(x: str) -> str:
    return f"CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 0.0::DOUBLE ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())::DOUBLE * 100 END"


@query(
    f"""SELECT match_id, comment_volume, upvote_total, goal_events, round(avg_sentiment, 6) AS avg_sentiment, round_even((e + h) / 2, 2) AS engagement_score, e AS excitement_index, h AS match_hype_score FROM (
SELECT *, round_even(0.4 * c + 0.3 * u + 0.3 * g, 2) AS e, round_even(0.5 * s + 0.3 * g + 0.2 * CASE WHEN is_rivalry THEN 100.0 ELSE 0.0 END, 2) AS h FROM (
SELECT *, {_scaled('comment_volume')} AS c, {_scaled('upvote_total')} AS u, {_scaled('goal_events')} AS g, {_scaled('(comment_volume + upvote_total)')} AS s FROM (
SELECT m.match_id, m.is_rivalry, CAST(coalesce(n, 0) AS BIGINT) AS comment_volume, CAST(coalesce(up, 0) AS BIGINT) AS upvote_total, CAST(coalesce(goals, 0) AS BIGINT) AS goal_events, coalesce(av, 0.0)::DOUBLE AS avg_sentiment
FROM matches m LEFT JOIN (SELECT match_id, count(*) AS n, sum(score) AS up, avg(sentiment) AS av FROM enriched GROUP BY match_id) USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS goals FROM goal_events GROUP BY match_id) USING (match_id))))""",
    "enriched",
    "goal_events",
)
def gen1_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = rel.goal_events(spark, sf_dir).groupBy("match_id").agg(F.count("*").alias("goal_events"))
    return metrics.build_engagement_metrics(rel.matches(spark, sf_dir), _social(spark, sf_dir), goals).withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query("SELECT coalesce(round_even((count(*) FILTER (WHERE score >= 53) - count(*) FILTER (WHERE score <= 47)) / nullif(count(*), 0)::DOUBLE, 4), 0.0)::DOUBLE AS fan_sentiment_score FROM enriched", "enriched")
def fan_sentiment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_of_counts(rel.link_sums(spark, sf_dir))


@query("SELECT match_id, round(median(sentiment), 6) AS avg_sentiment FROM enriched GROUP BY match_id", "enriched")
def sentiment_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.match_features(spark, sf_dir, "median").select("match_id", F.round("avg_sentiment", 6).alias("avg_sentiment"))


@query("SELECT match_id, round(CASE WHEN sum(greatest(score, 0)) > 0 THEN sum(sentiment * greatest(score, 0)) / sum(greatest(score, 0)) ELSE avg(sentiment) END, 6) AS avg_sentiment FROM enriched GROUP BY match_id", "enriched")
def sentiment_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.match_features(spark, sf_dir, "weighted_mean").select("match_id", F.round("avg_sentiment", 6).alias("avg_sentiment"))


@query("SELECT substr(external_id, 1, 3) || '_' || source AS author, count(*) AS frequency, round(avg(sentiment_score), 6) AS sentiment_mean, round(coalesce(stddev_samp(sentiment_score), 0), 6) AS sentiment_volatility, sum(upvotes)::DOUBLE AS engagement FROM items GROUP BY 1", "items")
def pseudo_author_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = segments.pseudo_author_features(_items(spark, sf_dir))
    return f.withColumns({c: F.round(c, 6) for c in ("sentiment_mean", "sentiment_volatility")})


def _robust(c: str) -> str:
    q = lambda p: f"(SELECT quantile_cont({c}, {p}) FROM fan_segments)"
    return f"round(({c} - {q(0.5)}) / coalesce(nullif({q(0.75)} - {q(0.25)}, 0), 1), 6) AS {c}_scaled"


@query(f"SELECT author, {_robust('comment_frequency')}, {_robust('sentiment_volatility')}, {_robust('engagement_activity')} FROM fan_segments", "fan_segments")
def robust_scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["comment_frequency", "sentiment_volatility", "engagement_activity"]
    return segments.scale(rel.fan_segments(spark, sf_dir), cols).select("author", *(F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in cols))


_VALUES = "map {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in LEXICON.items()) + "}"
VALENCE = f"valence AS (SELECT doc_id, text, coalesce(list_sum(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z'']+'), lambda w: coalesce(({_VALUES})[w], 0.0))), 0.0) AS v FROM documents)"
rel.CTES["valence"] = (VALENCE, ())


def _valence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "documents").select("doc_id", "text", F.round(sentiment.lexicon_valence(F.col("text"), LEXICON), 4).alias("v"))


@query("SELECT doc_id, round(round(v, 4) / sqrt(round(v, 4) * round(v, 4) + 15), 6) AS sentiment_score FROM valence", "valence")
def lexicon_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valence(spark, sf_dir).select("doc_id", F.round(sentiment.compound(F.col("v")), 6).alias("sentiment_score"))


@query("SELECT doc_id, CASE WHEN s >= 0.05 THEN 'positive' WHEN s <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM (SELECT doc_id, round(v, 4) / sqrt(round(v, 4) * round(v, 4) + 15) AS s FROM valence)", "valence")
def sentiment_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valence(spark, sf_dir).select("doc_id", polarity_label(sentiment.compound(F.col("v"))).alias("sentiment_label"))


def _any(terms) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{t.replace(chr(39), chr(39) * 2)}')" for t in terms) + ")"


@query(f"SELECT doc_id, CASE WHEN {_any(sentiment.EXCITEMENT_TERMS)} AND round(v, 4) >= 0 THEN 'excitement' WHEN {_any(sentiment.FRUSTRATION_TERMS)} AND round(v, 4) <= 0 THEN 'frustration' WHEN {_any(sentiment.OPTIMISM_TERMS)} THEN 'optimism' ELSE 'neutral' END AS emotion FROM valence", "valence")
def emotion_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valence(spark, sf_dir).select("doc_id", sentiment.emotion_label(F.col("text"), sentiment.compound(F.col("v"))).alias("emotion"))


@query("SELECT count(*) FILTER (WHERE score >= 53) AS positive, count(*) FILTER (WHERE score > 47 AND score < 53) AS neutral, count(*) FILTER (WHERE score <= 47) AS negative, round(coalesce(avg(sentiment), 0), 6) AS avg_score FROM enriched", "enriched")
def sentiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.summary(_social(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 6))


def _ranks(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"


@query(
    f"""SELECT round(auc, 6) AS auc, round(margin, 6) AS margin, round(least(greatest((margin + 1) / 2, 0), 1), 6) AS margin_norm, round(0.5 * auc + 0.5 * least(greatest((margin + 1) / 2, 0), 1), 6) AS composite FROM (
SELECT coalesce((sum(r) FILTER (WHERE y) - p * (p + 1) / 2.0::DOUBLE) / nullif(p * n, 0), 0.5)::DOUBLE AS auc, coalesce(avg(s) FILTER (WHERE y) - avg(s) FILTER (WHERE NOT y), 0)::DOUBLE AS margin
FROM (SELECT s, y, {_ranks('s')} AS r, count(*) FILTER (WHERE y) OVER () AS p, count(*) FILTER (WHERE NOT y) OVER () AS n FROM (SELECT round(engagement_score_combined, 9) AS s, is_rivalry AS y FROM ranking)) GROUP BY p, n)""",
    "ranking",
)
def rivalry_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = rel.combined(spark, sf_dir).withColumn("engagement_score_combined", F.round("engagement_score_combined", 9))
    out = evaluation.rivalry_metrics(scores, rel.matches(spark, sf_dir))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"SELECT round(corr(a, b), 6) AS spearman FROM (SELECT {_ranks('s')} AS a, {_ranks('total_goals')} AS b FROM (SELECT round(engagement_score_combined, 9) AS s, total_goals FROM ranking))", "ranking")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.ranking(spark, sf_dir).select(F.round("engagement_score_combined", 9).alias("s"), "total_goals")
    return evaluation.spearman(rows, "s", "total_goals").select(F.round("spearman", 6).alias("spearman"))


@query("SELECT match_id, total_goals, CAST(rank() OVER (ORDER BY total_goals DESC) AS BIGINT) AS rank FROM matches", "matches")
def match_rank_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.rank_min(rel.matches(spark, sf_dir).select("match_id", "total_goals"), "total_goals")


@query("SELECT match_id, total_goals, CAST(dense_rank() OVER (ORDER BY total_goals DESC) AS BIGINT) AS rank FROM matches", "matches")
def match_rank_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.rank_dense(rel.matches(spark, sf_dir).select("match_id", "total_goals"), "total_goals")


@query("SELECT match_id, home_team, CASE WHEN match_id % 300 = 0 OR match_id % 200 <> 0 THEN home_score + 10 ELSE home_score END AS home_score FROM matches WHERE match_id % 200 = 0 OR match_id % 300 = 0", "matches")
def upsert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rel.matches(spark, sf_dir).select("match_id", "home_team", "home_score")
    return merge.upsert(m.filter("match_id % 200 = 0"), m.filter("match_id % 300 = 0").withColumn("home_score", F.col("home_score") + 10), ["match_id"])


@query("SELECT external_id, source, CASE WHEN CAST(external_id AS BIGINT) % 2 = 0 THEN upvotes ELSE -1 END AS upvotes FROM items WHERE CAST(external_id AS BIGINT) % 2 = 0 OR CAST(external_id AS BIGINT) % 3 = 0", "items")
def insert_ignore_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).select("external_id", "source", "upvotes")
    n = F.col("external_id").cast("long")
    return merge.insert_ignore(i.filter(n % 2 == 0), i.filter(n % 3 == 0).withColumn("upvotes", F.lit(-1)), ["source", "external_id"])


@query("SELECT CAST(id AS VARCHAR) AS id, created_utc, subreddit, score FROM comments WHERE length(body) >= 18 AND subreddit IN ('click', 'view') AND created_utc BETWEEN 1704240000 AND 1705276800", "comments")
def accept_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = rel.comments(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "author", "body", F.col("created_utc").cast("string").alias("created_utc"), F.upper("subreddit").alias("subreddit"), F.col("score").cast("string").alias("score"), F.lit(None).cast("string").alias("link_id"))
    options = archive.ArchiveOptions("2024-01-03", "2024-01-15", ("Click", "view"), 18)
    return archive.canonical(archive.accept(raw, options), "archive").select("id", "created_utc", "subreddit", "score")


@query("SELECT source, external_id, min(upvotes) AS upvotes FROM (SELECT source, CAST(CAST(external_id AS BIGINT) // 2 AS VARCHAR) AS external_id, upvotes FROM items) GROUP BY 1, 2", "items")
def dedupe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).select("source", F.expr("CAST(CAST(external_id AS BIGINT) div 2 AS STRING)").alias("external_id"), "upvotes")
    return tables.dedupe_items(i)


@query("SELECT d AS day, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(week(d) AS INT) AS week, CAST(quarter(d) AS INT) AS quarter, coalesce(n, 0) AS fixtures FROM (SELECT CAST(unnest(generate_series((SELECT min(match_date) FROM matches), (SELECT max(match_date) FROM matches), INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN (SELECT match_date, count(*) AS n FROM matches GROUP BY 1) ON match_date = d", "matches")
def calendar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rel.matches(spark, sf_dir)
    days = m.agg(F.min("match_date").alias("a"), F.max("match_date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    per = m.groupBy("match_date").agg(F.count("*").alias("n"))
    return days.join(per, F.col("day") == F.col("match_date"), "left").select("day", F.year("day").alias("year"), F.month("day").alias("month"), F.weekofyear("day").alias("week"), F.quarter("day").alias("quarter"), F.coalesce("n", F.lit(0)).alias("fixtures"))


@query(
    """SELECT round(avg(CASE WHEN own_n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
SELECT vec_id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b, max(CASE WHEN own = other THEN n END) AS own_n FROM (
SELECT x.vec_id, x.label AS own, y.label AS other, sum(sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)))) AS s, count(*) AS n FROM embeddings x, embeddings y GROUP BY ALL) GROUP BY vec_id)"""
)
def silhouette_given_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.table(spark, sf_dir, "embeddings")
    return segments.silhouette(e, "vec_id", "embedding", "label").select(F.round("silhouette", 6).alias("silhouette"))


@query(
    """SELECT round((ab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM (
SELECT sum(c * (c - 1) / 2)::DOUBLE AS ab, sum(c)::DOUBLE AS n, (SELECT sum(m * (m - 1) / 2)::DOUBLE FROM (SELECT count(*) AS m FROM embeddings GROUP BY label)) AS sa,
(SELECT sum(m * (m - 1) / 2)::DOUBLE FROM (SELECT count(*) AS m FROM embeddings GROUP BY (label + vec_id % 3) % 10)) AS sb FROM (SELECT label, (label + vec_id % 3) % 10 AS b, count(*) AS c FROM embeddings GROUP BY ALL))"""
)
def ari_given_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.table(spark, sf_dir, "embeddings").select("label", ((F.col("label") + F.col("vec_id") % 3) % 10).alias("b"))
    return segments.adjusted_rand(e, "label", "b").select(F.round("ari", 6).alias("ari"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.fan_segments(spark, sf_dir).drop("segment")


@query()
def segments_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_authors(_points(spark, sf_dir))


@query()
def segments_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_authors(_points(spark, sf_dir), segments.SegmentOptions(clusterer="gmm_full"))


@query()
def segments_gen1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_fans(_items(spark, sf_dir))


@query()
def cluster_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["comment_frequency", "sentiment_volatility", "engagement_activity"]
    scaled = segments.scale(_points(spark, sf_dir), cols)
    return segments.cluster_stability(scaled, "author", [f"{c}_scaled" for c in cols], 4)


@query("SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS sentiment_score, 'length' AS sentiment_model FROM documents")
def analyzer_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzer = sentiment.FunctionAnalyzer("length", lambda texts: [float(len(t)) for t in texts])
    return sentiment.score_dataframe(rel.table(spark, sf_dir, "documents"), "text", analyzer=analyzer).select("doc_id", "sentiment_score", "sentiment_model")


@query("SELECT conv_id, turn, role, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])that($|[^\\p{L}\\p{N}_])') AS mentioned FROM conversations")
def conversation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", mentions(F.col("text"), "that").alias("mentioned"))


@query("SELECT created_utc // 3600 * 3600 AS hour, subreddit, count(*) AS comments FROM comments GROUP BY 1, 2", "comments")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.comments(spark, sf_dir).groupBy((F.floor(F.col("created_utc") / 3600) * 3600).alias("hour"), "subreddit").agg(F.count("*").alias("comments"))


@query("SELECT CAST(id AS VARCHAR) AS id, author, body, created_utc, subreddit, score FROM comments WHERE length(body) >= 15", "comments")
def ndjson_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments written as compressed NDJSON in the shared folder and ingested again."""
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp(prefix='turnstile-')}/ndjson-{uuid.uuid4().hex}"
    rel.comments(spark, sf_dir).select("id", "author", "body", "created_utc", "subreddit", "score").write.json(folder)
    source = archive.ArchiveSource(folder, suffixes="{json,jsonl}")
    return source.read(spark).select("id", "author", "body", "created_utc", "subreddit", "score")


assert RATIO_BAND == 0.1  # the oracles spell it as scores of 55 and 45
