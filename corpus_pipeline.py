"""From raw documents to packed bins: toxicity, quality rules, line dedup, near duplicates, packing.

Each stage is one of turnstile.llm's operators, works on all rows that the stage before kept, and is written as Parquet
and read again.  Rows keep the columns of documents until the last stage, which returns the bins: doc_ids with the
first word and the number of words of each piece.

Defined results, for all stages: a null text is an empty one.  Rows without doc_id are kept by the stages that compare
documents and packed under a null; rows that repeat a doc_id are one document where texts are compared.  Equal texts
keep the smallest doc_id.  Very long texts are taken whole.  Columns beyond those of documents pass through all stages
but the last, whatever their names; an empty table gives an empty table.

A stage of STAGES is called once the stage before it, over the same sf_dir, has been written; it then deletes the
tables which that one made on its way.  run() keeps its tables to itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstile.llm import common as cm
from turnstile.llm import op1_quality_rules, op4_line_dedup, op5_toxicity, op8_packing, op9_ngram_join


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5."""
    model = op5_toxicity.train(docs, cm.read_table(spark, sf_dir, "labels"))
    return op5_toxicity.score(docs, model, "__toxicity").filter("__toxicity < 0.5").drop("__toxicity")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    return op1_quality_rules.keep_good(docs, cm.read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those that lose all their words go."""
    return op4_line_dedup.remove_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates (five words, similarity 0.8)."""
    return op9_ngram_join.keep_first(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of best-fit packing."""
    return op8_packing.bins(op8_packing.pack(docs))


def _alone(k: int, stage):
    """The stage as the STAGES list offers it: once it is called, the tables that the one before made go."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _left.pop((sf_dir, k - 1), None)
        if before is not None:
            before.drop(spark)
        with cm.Tables() as made:
            out = stage(spark, docs, sf_dir)
        _left.setdefault((sf_dir, k), cm.Tables()).paths.update(made.paths)
        return out

    call.__name__, call.__doc__ = stage.__name__, stage.__doc__
    return call


#: Tables that the last call of a stage left for its result, by input and place in STAGES.
_left: dict[tuple[str, int], cm.Tables] = {}

_STAGES = (toxicity, quality_rules, line_dedup, near_duplicates, packing)
STAGES = [(f.__name__, _alone(k, f)) for k, f in enumerate(_STAGES)]

#: SQL expresses neither the trained classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents.  Tables made on the way are this run's own and go as soon as they are read;
    the result's table stays."""
    docs, was = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for stage in _STAGES:
        with cm.Tables() as made:
            out = stage(spark, docs, sf_dir)
        docs = cm.materialise(out)
        made.drop(spark)
        if was is not None:
            cm.discard(was)
        was = docs
    return docs
