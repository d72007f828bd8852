"""Author features, scaling, clustering and cluster quality."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstile.functions.exprs import RATIO_BAND, held, mean

EXCLUDED_AUTHORS = ("[deleted]", "AutoModerator", "")
LABELS = {3: ("Casual Fan", "Engaged Fan", "Ultra Fan"), 4: ("Casual Fan", "Tactical Fan", "Highly Engaged Fan", "Ultra Fan")}
#: Agglomerative clustering and the other numpy clusterers collect at most this many rows.
NUMPY_ROWS = 20_000
#: Rows of a piece of the points that clusters are fitted to.
PIECE_ROWS = 50_000
#: Points to each side of a cell of the silhouette's grid.
CELL_ROWS = 16_384


def author_features(enriched: DataFrame, min_comments: int = 3, band: float = RATIO_BAND) -> DataFrame:
    """Features of authors with at least min_comments; the primary community is the most frequent, ties by name."""
    rows = enriched.filter(F.col("author").isNotNull() & ~F.col("author").isin(*EXCLUDED_AUTHORS))
    subs = rows.groupBy("author", "subreddit").agg(F.count("*").alias("n")).groupBy("author").agg(F.min(F.struct((-F.col("n")).alias("k"), "subreddit"))["subreddit"].alias("primary_subreddit"))
    per = rows.groupBy("author").agg(
        F.count("*").alias("comment_frequency"),
        mean(F.col("sentiment")).alias("avg_sentiment"),
        F.coalesce(F.stddev_samp("sentiment"), F.lit(0.0)).alias("sentiment_volatility"),
        F.coalesce(F.sum("score"), F.lit(0)).cast("double").alias("engagement_activity"),
        F.count_distinct("match_id").alias("matches_covered"),
        F.avg((F.col("sentiment") >= band).cast("double")).alias("positive_ratio"),
    )
    return per.filter(F.col("comment_frequency") >= min_comments).join(subs, "author")


def pseudo_author_features(items: DataFrame) -> DataFrame:
    """Gen-1: an author is the first three characters of external_id and the source."""
    rows = items.withColumn("author", F.concat(F.substring("external_id", 1, 3), F.lit("_"), F.col("source")))
    per = rows.groupBy("author").agg(F.count("*").alias("frequency"), F.avg("sentiment_score").alias("sentiment_mean"), F.stddev_samp("sentiment_score").alias("sentiment_volatility"), F.sum("upvotes").cast("double").alias("engagement"))
    return per.na.fill(0.0)


def scale(df: DataFrame, columns: list[str], kind: str = "robust") -> DataFrame:
    """Adds <column>_scaled: standard (population deviation), minmax, robust (exact median and quartiles) or none.

    One aggregate makes the constants; a constant column scales by 1, as if its spread were 1.
    """
    if kind == "none":
        return df.withColumns({f"{c}_scaled": F.col(c).cast("double") for c in columns})
    q = lambda c, p: F.percentile(c, F.lit(p))
    parts = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)), "robust": lambda c: (q(c, 0.5), q(c, 0.75) - q(c, 0.25))}[kind]
    made = [x.alias(f"__{n}_{c}") for c in columns for n, x in zip(("mid", "by"), parts(c), strict=True)]
    joined = df.crossJoin(F.broadcast(df.agg(*made)))
    by = lambda c: F.when(F.col(f"__by_{c}") == 0, 1.0).otherwise(F.col(f"__by_{c}"))
    out = joined.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"__mid_{c}")) / by(c) for c in columns})
    return out.drop(*(f"__{n}_{c}" for c in columns for n in ("mid", "by")))


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="__features").transform(df)


def _side_by_side(spark: SparkSession, run: Callable, over: Iterable) -> list:
    """run() of each, in order, in as many threads as there are cores."""
    with ThreadPool(max(1, spark.sparkContext.defaultParallelism)) as pool:
        return pool.map(inheritable_thread_target(spark)(run), over, chunksize=1)


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42, restarts: int = 10, max_iter: int = 50) -> DataFrame:
    """Adds cluster (int): the fit of lowest cost among the restarts."""
    # Few rows in few pieces: a fit is a chain of small jobs, and the restarts run side by side.
    vectors = _vectors(df.select(*columns), columns).select("__features").persist()
    data = vectors.coalesce(max(1, -(-vectors.count() // PIECE_ROWS))).persist()
    try:
        fit = lambda r: KMeans(k=k, seed=seed + r, maxIter=max_iter, featuresCol="__features", predictionCol="cluster").fit(data)
        fits = _side_by_side(df.sparkSession, fit, range(restarts))
        best = min(fits, key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()
        vectors.unpersist()
    return best.transform(_vectors(df, columns)).drop("__features")


def gaussian_mixture(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """Full covariance; the other kinds are numpy_mixture()."""
    data = _vectors(df, columns)
    model = GaussianMixture(k=k, seed=seed, featuresCol="__features", predictionCol="cluster", probabilityCol="__p").fit(data)
    return model.transform(data).drop("__features", "__p")


def _collect(df: DataFrame, key: str, columns: list[str]) -> tuple[list, np.ndarray]:
    rows = df.select(key, *columns).orderBy(key).limit(NUMPY_ROWS + 1).collect()
    if len(rows) > NUMPY_ROWS:
        raise ValueError(f"more than {NUMPY_ROWS} rows; use kmeans or gaussian_mixture")
    return [r[0] for r in rows], np.array([[float(v) for v in r[1:]] for r in rows]).reshape(len(rows), len(columns))


def numpy_mixture(df: DataFrame, key: str, columns: list[str], k: int, covariance: str = "diag", steps: int = 100) -> DataFrame:
    """EM with tied, diag or spherical covariance for small inputs; raises beyond NUMPY_ROWS."""
    ids, x = _collect(df, key, columns)
    n, d = x.shape
    order = np.argsort(x[:, 0], kind="stable")
    resp = np.zeros((n, k))
    resp[order, np.arange(n) * k // max(n, 1)] = 1
    for _ in range(steps):
        weight = resp.sum(0) + 1e-9
        mean = resp.T @ x / weight[:, None]
        square = resp.T @ (x**2) / weight[:, None] - mean**2 + 1e-6
        if covariance == "spherical":
            square = np.repeat(square.mean(1, keepdims=True), d, 1)
        elif covariance == "tied":
            full = sum((resp[:, j, None] * (x - mean[j])).T @ (x - mean[j]) for j in range(k)) / n + 1e-6 * np.eye(d)
            inv, logdet = np.linalg.inv(full), np.linalg.slogdet(full)[1]
            log_p = np.stack([-0.5 * (np.einsum("ni,ij,nj->n", x - m, inv, x - m) + logdet) for m in mean], 1)
        elif covariance != "diag":
            raise ValueError(f"unknown covariance: {covariance}")
        if covariance != "tied":
            log_p = np.stack([-0.5 * (((x - m) ** 2 / s).sum(1) + np.log(s).sum()) for m, s in zip(mean, square, strict=True)], 1)
        log_p += np.log(weight / n)
        new = np.exp(log_p - log_p.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - resp).max() < 1e-6:
            break
        resp = new
    return _labelled(df, key, ids, resp.argmax(1))


def agglomerative(df: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """Ward linkage for small inputs, by nearest-neighbour chains; raises beyond NUMPY_ROWS."""
    ids, x = _collect(df, key, columns)
    n = len(ids)
    centre, size = {i: x[i] for i in range(n)}, dict.fromkeys(range(n), 1)
    cost = lambda a, b: size[a] * size[b] / (size[a] + size[b]) * float(((centre[a] - centre[b]) ** 2).sum())
    merges, chain, label = [], [], n
    while len(centre) > 1:
        if not chain:
            chain.append(min(centre))
        while True:
            a = chain[-1]
            b = min((c for c in centre if c != a), key=lambda c: (cost(a, c), c != (chain[-2] if len(chain) > 1 else None), c))
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        merges.append((cost(a, b), a, b, label))
        total = size[a] + size[b]
        centre[label] = (centre.pop(a) * size[a] + centre.pop(b) * size[b]) / total
        size[label] = total
        label += 1
        del chain[-2:]
    parent = {}
    for _, a, b, made in sorted(merges)[: max(n - k, 0)]:
        parent[a] = parent[b] = made
    roots: dict = {}
    out = []
    for i in range(n):
        r = i
        while r in parent:
            r = parent[r]
        out.append(roots.setdefault(r, len(roots)))
    return _labelled(df, key, ids, np.array(out, dtype=int))


def _labelled(df: DataFrame, key: str, ids: list, labels: np.ndarray) -> DataFrame:
    schema = f"__key {df.schema[key].dataType.simpleString()}, cluster int"
    made = df.sparkSession.createDataFrame([(i, int(c)) for i, c in zip(ids, labels, strict=True)], schema)
    return df.join(made, df[key] == made["__key"]).drop("__key")


def name_segments(df: DataFrame, order_by: str, k: int) -> DataFrame:
    """Adds segment: clusters named by ascending mean of a column."""
    names = LABELS.get(k) or tuple(f"Segment {i + 1}" for i in range(k))
    means = df.groupBy("cluster").agg(F.avg(order_by).alias("__m"))
    place = F.row_number().over(Window.orderBy("__m", "cluster"))
    named = means.withColumn("segment", F.element_at(F.array(*map(F.lit, names)), place)).select("cluster", "segment")
    return df.join(F.broadcast(named), "cluster")


@dataclass(frozen=True)
class SegmentOptions:
    k: int = 4
    scaler: str = "robust"
    clusterer: str = "kmeans"
    seed: int = 42
    min_authors: int = 4


def segment_authors(features: DataFrame, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    """v1.1: scaled frequency, volatility and activity, clustered and named by activity."""
    columns = ["comment_frequency", "sentiment_volatility", "engagement_activity"]
    if features.limit(options.min_authors).count() < options.min_authors:
        raise ValueError(f"fewer than {options.min_authors} authors")
    scaled = held(scale(features, columns, options.scaler))
    return name_segments(cluster(scaled, "author", [f"{c}_scaled" for c in columns], options.k, options.clusterer, options.seed), "engagement_activity", options.k).drop(*(f"{c}_scaled" for c in columns))


def cluster(df: DataFrame, key: str, columns: list[str], k: int, clusterer: str = "kmeans", seed: int = 42) -> DataFrame:
    if clusterer == "kmeans":
        return kmeans(df, columns, k, seed)
    if clusterer == "agglomerative":
        return agglomerative(df, key, columns, k)
    kind, _, covariance = clusterer.partition("_")
    if kind == "gmm":
        return gaussian_mixture(df, columns, k, seed) if covariance in ("", "full") else numpy_mixture(df, key, columns, k, covariance)
    raise ValueError(f"unknown clusterer: {clusterer}")


def segment_fans(items: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """v1.0: pseudo authors, standard scaling; fewer than three stay unsegmented."""
    features = pseudo_author_features(items)
    if features.limit(3).count() < 3:
        return features.withColumn("segment", F.lit("Unsegmented"))
    columns = ["frequency", "sentiment_volatility", "engagement"]
    scaled = held(scale(features, columns, "standard"))
    return name_segments(kmeans(scaled, [f"{c}_scaled" for c in columns], k, seed), "engagement", k).drop("cluster", *(f"{c}_scaled" for c in columns))


def silhouette(points: DataFrame, key: str, vector: str, label: str, block_rows: int = 512) -> DataFrame:
    """One row, exact mean Euclidean silhouette: every point against all points, in blocks.

    vector: array<double>.  Points are dealt to the rows and the columns of a grid; a cell holds at most about CELL_ROWS
    points of each side, measures them block by block, and only sums a point and cluster leave it.  The work is quadratic, as
    the measure is, but no pair of points becomes a row, and a task holds one cell.
    """
    import pandas as pd
    import pyarrow as pa

    rows = points.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("long").alias("label"))
    n, cores = rows.count(), points.sparkSession.sparkContext.defaultParallelism
    side = max(1, -(-n // CELL_ROWS), min(-(-n // block_rows), int(np.ceil(np.sqrt(4 * cores)))))
    cut = rows.withColumn("at", F.pmod(F.xxhash64("key"), F.lit(side)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    left = cut.withColumnRenamed("at", "a").withColumn("b", every)
    right = cut.withColumnRenamed("at", "b").withColumn("a", every)
    schema = pa.schema([("key", pa.string()), ("own", pa.int64()), ("other", pa.int64()), ("total", pa.float64()), ("n", pa.int64())])

    def parts(table):
        x = table.column("x").combine_chunks()
        flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 0))
        return table.column("key").to_numpy(zero_copy_only=False), flat, table.column("label").to_numpy(zero_copy_only=False)

    def sums(cell, one, other):
        (keys, x, own), (names, y, labels) = parts(one), parts(other)
        if not len(x) or not len(y):
            return schema.empty_table()
        kinds, kind = np.unique(labels, return_inverse=True)
        member = np.zeros((len(y), len(kinds)))
        member[np.arange(len(y)), kind] = 1
        # Numbers for keys, where the same point can be on both sides.
        code = pd.factorize(np.concatenate([keys, names]))[0] if cell[0].as_py() == cell[1].as_py() else None
        total, xx, yy = np.zeros((len(x), len(kinds))), (x**2).sum(1), (y**2).sum(1)
        for i in range(0, len(x), block_rows):
            for j in range(0, len(y), block_rows):
                dist = x[i : i + block_rows] @ y[j : j + block_rows].T
                dist *= -2
                dist += xx[i : i + block_rows, None]
                dist += yy[None, j : j + block_rows]
                np.sqrt(np.maximum(dist, 0, out=dist), out=dist)
                if code is not None:
                    dist[code[: len(x)][i : i + block_rows, None] == code[len(x) :][None, j : j + block_rows]] = 0
                total[i : i + block_rows] += dist @ member[j : j + block_rows]
        m = len(kinds)
        made = (np.repeat(keys, m), np.repeat(own, m), np.tile(kinds, len(x)), total.ravel(), np.tile(member.sum(0).astype(np.int64), len(x)))
        return pa.table([pa.array(v, t) for v, t in zip(made, schema.types, strict=True)], schema=schema)

    cells = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(sums, "key string, own long, other long, total double, n long")
    total = cells.groupBy("key", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.when(F.col("own") == F.col("other"), F.try_divide(F.col("total"), F.col("n") - 1)).otherwise(F.col("total") / F.col("n"))
    same = F.col("own") == F.col("other")
    per = total.withColumn("mean", mean).groupBy("key").agg(F.max(F.when(same, F.col("mean"))).alias("a"), F.min(F.when(~same, F.col("mean"))).alias("b"), F.max(F.when(same, F.col("n"))).alias("own_n"))
    s = F.when((F.col("own_n") <= 1) | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.agg(F.avg(s).alias("silhouette"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two label columns, from their contingency counts."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    choose = lambda c: F.col(c) * (F.col(c) - 1) / 2
    both = cells.agg(F.sum(choose("n")).alias("ab"), F.sum("n").alias("n"))
    side = lambda c, to: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(choose("m")).alias(to))
    one = both.crossJoin(side("a", "sa")).crossJoin(side("b", "sb"))
    expected = F.try_divide(F.col("sa") * F.col("sb"), choose("n"))
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    return one.select(F.when(F.coalesce(top, F.lit(0.0)) == 0, 1.0).otherwise((F.col("ab") - expected) / F.when(top == 0, 1.0).otherwise(top)).alias("ari"))


def cluster_stability(df: DataFrame, key: str, columns: list[str], k: int, clusterer: str = "kmeans", runs: int = 10, share: float = 0.8, seed: int = 42) -> DataFrame:
    """(run, ari): clusterings of hash-chosen subsamples against the clustering of all rows."""
    df = held(df.select(key, *columns))
    base = held(cluster(df, key, columns, k, clusterer, seed).select(key, F.col("cluster").alias("base")))
    out = None
    for b in range(runs):
        chosen = df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(b)), F.lit(1000)) < int(share * 1000))
        again = cluster(chosen, key, columns, k, clusterer, b + 1).select(key, "cluster")
        one = adjusted_rand(again.join(base, key), "base", "cluster").select(F.lit(b).alias("run"), "ari")
        out = one if out is None else out.unionByName(one)
    return out
