"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule rejects a text whose ratio lies above a cutoff.  The cutoffs come from labelled holdouts: among n good
(quality 1) labelled documents of a stratum, k lie above the cutoff.  The cutoff's false-rejection rate is at most
RISK / number of rules with confidence 1 - p, p = P[Bin(n, RISK / rules) <= k], an exact binomial tail.  Cutoffs of a
rule are tried from the most lenient down (a fixed sequence: the first that fails ends it, so each needs no share of
the error), and the error DELTA is divided over all strata and rules (Bonferroni).  With probability 1 - DELTA at
least, no stratum loses more than RISK of its good documents to all rules together.  A stratum whose holdout is too
small to certify any cutoff rejects nothing beyond the base rules.

Defined results: null text is empty: no words, so it fails the base rule.  A null stratum is the stratum ''.  Labels
without doc_id or quality are ignored; repeated rows of a document count once, as good if any row says so.  Extra
columns are ignored.  No labels: base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm import common as cm

RISK = 0.02
DELTA = 0.05
#: Rules: a ratio of each text and the cutoffs tried, most lenient first (in thousandths).
RULES = {"symbols": "1000 * n_symbols / greatest(word_chars, 1)", "repeats": "1000 * n_repeat_words / greatest(n_words, 1)", "lines": "1000 * n_dup_lines / greatest(n_lines, 1)", "capitals": "1000 * n_capitals / greatest(word_chars, 1)", "shouts": "1000 * n_shouts / greatest(n_words, 1)"}
GRID = tuple(range(990, 0, -10))

_SPACE = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows are sorted by (hash, words, place); equal neighbours are repeats.  Their places, sorted, cover three words
    each less what the next one covers.
    """
    n = F.size(words)
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    keyed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    order = F.array_sort(keyed)

    def with_order(o: Column) -> Column:
        at = lambda k: F.get(o, k)
        same = lambda a, b: F.when(a["h"] == b["h"], window(a["i"]) == window(b["i"])).otherwise(F.lit(False))
        hits = F.filter(o, lambda x, k: F.coalesce(same(x, at(k + 1)), F.lit(False)) | F.coalesce(same(x, at(k - 1)), F.lit(False)))
        return F.array_sort(F.transform(hits, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    count = bind(bind(order, with_order), covered)
    return F.when(n < 4, F.lit(0)).otherwise(count).cast("long")


def bind(value: Column, f) -> Column:
    """f(value), value being evaluated once: a lambda variable instead of a repeated expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, stratum and the counts that rules are made of; one pass over the text, no shuffle.

    carry: the input's own columns come along, as the struct column row.
    """
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    own = lambda c, t: (F.col(c) if c in docs.columns else F.lit(None)).cast(t)
    docs = docs.select(own("doc_id", "long").alias("doc_id"), F.coalesce(own("lang", "string"), F.lit("")).alias("stratum"), F.coalesce(own("text", "string"), F.lit("")).alias("text"), *row)
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACE, "") != "")
    size = lambda c: F.size(c).cast("long")
    rows = ["row"] if carry else []
    counts = docs.select(
        "doc_id",
        "stratum",
        *rows,
        F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_shouts"),
        bind(lines, lambda x: F.struct(size(x).alias("n"), (size(x) - size(F.array_distinct(x))).alias("dup"))).alias("l"),
        bind(_words(text), lambda w: F.struct(size(w).alias("n"), _repeat_words(w).alias("rep"))).alias("w"),
    )
    return counts.select("doc_id", "stratum", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_capitals", "n_shouts", *rows)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P[Bin(n, p) <= k], exactly: terms summed in the logarithm, from the ratio of neighbouring terms."""
    odds = F.lit(p / (1 - p))
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j * odds)
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.exp(F.aggregate(steps, start, add)["sum"]))


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) certified; one row a stratum and rule at most, however large the corpus."""
    good = cm.with_columns(labels, doc_id="long", quality="int").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    base_ok = counted.filter("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    held = base_ok.join(good, "doc_id", "left_semi")
    # Per stratum, rule and grid place: how many good documents lie above; ratios are first cut to grid steps.
    steps = [F.floor(F.expr(e) / 10).cast("long") for e in RULES.values()]
    long = held.select("stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.least(s, F.lit(99).cast("long")).alias("step")) for r, s in zip(RULES, steps, strict=True)))).alias("x"))
    at_step = long.groupBy("stratum", "x.rule", "x.step").agg(F.count("*").alias("c"))
    # At most strata * rules * 100 rows from here on.
    per_rule = at_step.groupBy("stratum", "rule").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "c"))).alias("by_step"))
    strata = per_rule.select("stratum").distinct().agg(F.count("*").alias("strata"))
    grid = per_rule.crossJoin(F.broadcast(strata)).select("stratum", "rule", "n", "strata", F.explode(F.array(*(F.lit(g).cast("long") for g in GRID))).alias("cutoff"), "by_step")
    above = F.aggregate(F.map_entries("by_step"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] >= F.col("cutoff") / 10, e["value"]).otherwise(F.lit(0).cast("long")))
    share = risk / len(RULES)
    tested = grid.select("stratum", "rule", "cutoff", "n", "strata", above.alias("k"))
    # A tail is only summed where k is below the mean; at or above it the bound cannot hold.
    p = F.when(F.col("k") < F.col("n") * share, binomial_tail(F.least(F.col("k"), F.ceil(F.col("n") * share)), F.col("n"), share)).otherwise(F.lit(1.0))
    passed = tested.select("stratum", "rule", "cutoff", (p <= delta / (F.col("strata") * len(RULES))).alias("ok"))
    ends = passed.groupBy("stratum", "rule").agg(F.max(F.when(~F.col("ok"), F.col("cutoff"))).alias("failed"), F.min(F.when(F.col("ok"), F.col("cutoff"))).alias("lowest"), F.collect_list(F.when(F.col("ok"), F.col("cutoff"))).alias("oks"))
    return ends.select("stratum", "rule", F.array_min(F.filter("oks", lambda c: F.col("failed").isNull() | (c > F.col("failed")))).alias("cutoff")).filter("cutoff is not null")


def judge(counted: DataFrame, certified: DataFrame) -> DataFrame:
    """counted plus base_failed and kept; counted should be materialised, as certified was made from it."""
    wide = certified.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.lit(False)
    for r, e in RULES.items():
        over = over | F.coalesce(F.floor(F.expr(e) / 10) >= F.col(f"cut_{r}") / 10, F.lit(False))
    # One row a stratum: as many as languages.
    joined = counted.join(wide.withColumnRenamed("stratum", "of"), F.col("stratum") == F.col("of"), "left")
    return joined.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~over).drop("of", *(f"cut_{r}" for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    counted = cm.materialise(measures(docs))
    return judge(counted, cm.materialise(cutoffs(counted, labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, as they came."""
    counted = cm.materialise(measures(docs, carry=True))
    return judge(counted, cm.materialise(cutoffs(counted, labels))).filter("kept").select("row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(cm.read_table(spark, sf_dir, "documents"), cm.read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The same in DuckDB, windows by unnesting and the binomial tail by log-gamma."""
    share = RISK / len(RULES)
    rules = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, CAST(floor(({e}) / 10) AS BIGINT) AS step FROM c" for r, e in RULES.items())
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_shouts
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
r AS ({rules}),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT r.* FROM r JOIN c USING (doc_id) JOIN good USING (doc_id) WHERE n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words),
grid AS (SELECT stratum, rule, g * 10 AS cutoff, count(*) AS n, count(*) FILTER (WHERE step >= g) AS k FROM held, range(1, 100) AS x(g) GROUP BY ALL),
s AS (SELECT count(DISTINCT stratum) AS strata FROM held),
tail AS (SELECT stratum, rule, cutoff, any_value(strata) AS strata, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share}))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM grid WHERE k < n * {share}) , s GROUP BY stratum, rule, cutoff),
ok AS (SELECT g.stratum, g.rule, g.cutoff, coalesce(p <= {DELTA} / (strata * {len(RULES)}), false) AS ok FROM grid g LEFT JOIN tail USING (stratum, rule, cutoff)),
bad AS (SELECT stratum, rule, coalesce(max(cutoff) FILTER (WHERE NOT ok), -1) AS failed FROM ok GROUP BY ALL),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM ok JOIN bad USING (stratum, rule) WHERE ok AND cutoff > failed GROUP BY ALL),
over AS (SELECT DISTINCT r.doc_id FROM r JOIN cut USING (stratum, rule) WHERE step >= cutoff / 10),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND over.doc_id IS NULL AS kept
FROM f LEFT JOIN over ON over.doc_id = f.doc_id"""
