"""Column expressions and small frame helpers shared by the operators; all JVM-side."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Label band (inclusive) and the wider band of per-fixture ratios.
LABEL_BAND = 0.05
RATIO_BAND = 0.1
#: Ranges narrower than this count as constant in min-max scaling.
FLAT = 1e-12
#: Sums of mean(): 27 decimals hold every digit of a double from 1e-10 on, and leave room for sums below 1e11.
EXACT, EXACT_RANGE = "decimal(38, 27)", (1e-10, 1e10)


def require_columns(df: DataFrame, columns: list[str], what: str = "input") -> None:
    """Raise ValueError naming what is missing; no job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")


def held(df: DataFrame) -> DataFrame:
    """Computed once: in the shared folder (spark.checkpoint.dir), or in the executors' storage where none is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.localCheckpoint()
    path = f"{folder}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.held_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what held() wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "held_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def mean(x: Column) -> Column:
    """The mean of doubles as they read in decimal: the same in any order of rows, where a sum of doubles is not.

    Rounded, that tells on a tie: 64 values that add up to 6.62 have the mean 0.1034375, which a sum in doubles misses by a
    bit to either side.  A group with values or a sum beyond the range (or NaN) gets the plain average.
    """
    x = x.cast("double")
    held = F.when((x == 0) | F.abs(x).between(*EXACT_RANGE), x).cast(EXACT)
    exact = F.when(F.count(held) == F.count(x), F.try_divide(F.try_sum(held), F.count(x)).cast("double"))
    return F.coalesce(exact, F.avg(x))


def mean_parts(x: Column) -> dict[str, Column]:
    """What merged_mean() needs of each part of a group."""
    x = x.cast("double")
    held = F.when((x == 0) | F.abs(x).between(*EXACT_RANGE), x).cast(EXACT)
    return {"n": F.count(x), "held": F.count(held), "exact": F.try_sum(held), "plain": F.sum(x)}


def merged_mean(times: Column | None = None) -> Column:
    """mean() of groups put together from parts with the columns of mean_parts(), each counted that many times.

    A part's exact sum is split at the point, as no decimal type holds its product with a count; 26 decimals of the whole sum
    are kept.
    """
    n = F.col("n") * (F.lit(1) if times is None else times)
    usable = F.count_if((F.col("n") > 0) & (F.col("exact").isNull() | (F.col("held") < F.col("n")))) == 0
    if times is None:
        total = F.try_sum("exact")
    else:
        usable &= F.max(times) < 10**10
        count = times.try_cast("decimal(10, 0)")
        whole = F.try_sum(F.expr("exact div 1").cast("decimal(11, 0)") * count)
        total = F.try_add(whole.try_cast("decimal(11, 0)"), F.try_sum((F.col("exact") % 1).cast("decimal(27, 27)") * count))
    plain = F.sum("plain") if times is None else F.sum(F.col("plain") * times)
    return F.coalesce(F.when(usable, F.try_divide(total, F.sum(n)).cast("double")), F.try_divide(plain, F.sum(n)))


def polarity_label(score: Column, band: float = LABEL_BAND) -> Column:
    return F.when(score >= band, "positive").when(score <= -band, "negative").otherwise("neutral")


def mentions(text: Column, alias: str) -> Column:
    """Whole-word, case-insensitive hit of a literal; letters, digits and _ of any script are word characters.

    The substring test is cheap and rules out most texts before the expression runs.
    """
    low = F.lower(text)
    return F.contains(low, F.lit(alias.lower())) & low.rlike(word_pattern(alias))


def word_pattern(alias: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_]){re.escape(alias.lower()).replace(chr(92) + ' ', ' ')}($|[^\p{{L}}\p{{N}}_])"


def min_max(df: DataFrame, columns: dict[str, str], scale: float = 1.0, flat: float = FLAT) -> DataFrame:
    """Append out = (x - min) / (max - min) * scale for each {x: out}; 0 where the range is flat.

    One one-row aggregate joined back, so nothing is gathered in one partition as a global window would.
    """
    bounds = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(bounds))
    for c, to in columns.items():
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out = out.withColumn(to, F.when(hi - lo < flat, 0.0).when(hi.isNull(), None).otherwise((F.col(c) - lo) / (hi - lo) * scale))
    return out.drop(*(f"__{n}_{c}" for c in columns for n in ("lo", "hi")))


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean.

    Distinct values are counted first; the running sum runs over those alone, so its one task holds a row a value.
    Meant for fixture-sized frames, as its users are.
    """
    counts = df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = counts.withColumn("__before", F.sum("__n").over(Window.orderBy(F.col("__v").asc_nulls_first())) - F.col("__n"))
    joined = df.join(ranked, df[column].eqNullSafe(ranked["__v"]))
    return joined.withColumn(out, F.col("__before") + (F.col("__n") + 1) / 2).drop("__v", "__n", "__before")
