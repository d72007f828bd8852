"""Separation and agreement measures, phase composites, and the keep-if-better search."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.exprs import average_rank, clip

AUC_WEIGHT, MARGIN_WEIGHT = 0.5, 0.5
SILHOUETTE_WEIGHT, STABILITY_WEIGHT = 0.6, 0.4


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the curve from average ranks (exact with ties); 0.5 when one class is missing."""
    ranked = average_rank(df.select(F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"), F.coalesce(F.col(label).cast("boolean"), F.lit(False)).alias("y")), "s", "r")
    sums = ranked.agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"), F.coalesce(F.sum(F.when(F.col("y"), F.col("r"))), F.lit(0.0)).alias("r"))
    return sums.select(F.coalesce(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * F.col("n")).cast("double")), F.lit(0.5)).alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation with average ranks; 0 for fewer than three rows or a constant side."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    ranked = average_rank(average_rank(rows, "a", "ra"), "b", "rb")
    sums = ranked.agg(F.count("*").alias("n"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"), F.covar_pop("ra", "rb").alias("c"))
    return sums.select(F.when(F.col("n") < 3, 0.0).otherwise(F.coalesce(F.try_divide("c", F.col("sa") * F.col("sb")), F.lit(0.0))).alias("spearman"))


def overridden(scores: DataFrame, override: DataFrame | None, score: str) -> DataFrame:
    """scores with the score that override (match_id, score) has for a fixture; a missing or null one falls back."""
    if override is None:
        return scores
    other = override.filter("score IS NOT NULL").groupBy("match_id").agg(F.max("score").alias("__override"))
    return scores.join(other, "match_id", "left").withColumn(score, F.coalesce("__override", score)).drop("__override")


def rivalry_metrics(scores: DataFrame, fixtures: DataFrame, score: str = "engagement_score_combined", override: DataFrame | None = None) -> DataFrame:
    """One row: auc, margin, margin_norm, composite."""
    scores = overridden(scores, override, score)
    flags = fixtures.select("match_id", F.col("is_rivalry").alias("__y"))
    rows = scores.join(flags, "match_id", "left").select(F.coalesce(F.col(score), F.lit(0.0)).alias("s"), F.coalesce("__y", F.lit(False)).alias("y"))
    margin = rows.agg(F.coalesce(F.avg(F.when(F.col("y"), F.col("s"))) - F.avg(F.when(~F.col("y"), F.col("s"))), F.lit(0.0)).alias("margin"))
    one = roc_auc(rows, "s", "y").crossJoin(margin).withColumn("margin_norm", clip((F.col("margin") + 1) / 2, 0.0, 1.0))
    return one.withColumn("composite", AUC_WEIGHT * F.col("auc") + MARGIN_WEIGHT * F.col("margin_norm"))


def rank_min(df: DataFrame, score: str, out: str = "rank") -> DataFrame:
    """Ranks from 1 by descending score, ties sharing the smallest; for fixture-sized frames."""
    return df.withColumn(out, F.rank().over(Window.orderBy(F.col(score).desc_nulls_last())).cast("long"))


def rank_dense(df: DataFrame, score: str, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.dense_rank().over(Window.orderBy(F.col(score).desc_nulls_last())).cast("long"))


def top_ranked(df: DataFrame, score: str, k: int = 3) -> DataFrame:
    return rank_min(df, score).orderBy("rank", "match_id").limit(k)


def phase1_composite(silhouette: float, stability: float) -> float:
    return SILHOUETTE_WEIGHT * silhouette + STABILITY_WEIGHT * stability


@dataclass
class Ratchet:
    """Keeps a configuration only if it is strictly better; state is a small JSON file on the driver."""

    path: str
    target: float = 1.0
    patience: int = 5
    state: dict = field(default_factory=lambda: {"best": None, "config": None, "tried": 0, "stale": 0})

    def __post_init__(self) -> None:
        if Path(self.path).exists():
            self.state |= json.loads(Path(self.path).read_text())

    def offer(self, config: dict, value: float) -> bool:
        better = self.state["best"] is None or value > self.state["best"]
        self.state["tried"] += 1
        self.state["stale"] = 0 if better else self.state["stale"] + 1
        if better:
            self.state |= {"best": value, "config": config}
        Path(self.path).write_text(json.dumps(self.state))
        return better

    def exit_code(self) -> int:
        """3: target reached; 4: no gain for patience tries; 0: go on."""
        if self.state["best"] is not None and self.state["best"] >= self.target:
            return 3
        return 4 if self.state["stale"] >= self.patience else 0


def grid_search(configs: Iterable[dict], measure: Callable[[dict], float], ratchet: Ratchet) -> dict:
    """Measure each configuration (over inputs the caller has persisted) until the ratchet stops; a failing one scores -1."""
    for config in configs:
        try:
            value = measure(config)
        except (ValueError, ArithmeticError):
            value = -1.0
        ratchet.offer(config, value)
        if ratchet.exit_code():
            break
    return ratchet.state
