"""Toxicity: non-negative positive-unlabelled learning of a sparse linear numpy classifier.

Confirmed toxic examples are the positives; all else is unlabelled text, whose own labels are never read.  With class
prior p (the confirmed share among labelled training rows) the risk is
p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)]) (Kiryo et al., 2017): the bracket estimates the risk on negatives
and is held at zero or above, so where it falls below it adds no gradient.  The loss is logistic, so that sigmoid(f)
estimates the probability; an L1 proximal step keeps weights small.  Where the bracket swings about zero the last step
is one of its turns, so the mean of the last half of the steps is taken.

A text's features are its distinct words and their first PREFIXES bytes, A-Z lowered, hashed to 2**FEATURE_BITS.  Training
reads a bounded sample, MAX_POSITIVE and MAX_UNLABELLED documents by smallest hash of doc_id; scoring reads every text.

Defined results: null or empty text has no features and scores by the bias alone.  Without confirmed examples every
score is 0.  A null doc_id is never a training row and not held out.  Repeated label rows count once (toxic if any is).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm import common as cm
from turnstile.llm import textvec as tv

FEATURE_BITS = 20
PREFIXES = (4, 5, 6)
MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
#: A feature is learnt if this many positive documents of the sample have it.
MIN_POSITIVE_DF = 2


def _features(chunk: tv.Chunk, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the chunk, bucket), distinct, of the features that keep (a mask over buckets) has."""
    spans = tv.runs(chunk, tv.ALNUM)
    prefix = tv.prefix_hash(chunk, lower=True)
    rows, buckets = [], []
    for k in (None, *PREFIXES):
        end = spans.end if k is None else np.minimum(spans.start + k, spans.end)
        h = (tv.span_hash(prefix, spans.start, end) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        hit = keep[h]
        if k is not None:  # a word no longer than the prefix has it already
            hit &= end < spans.end
        rows.append(spans.row[hit])
        buckets.append(h[hit])
    key = np.unique((np.concatenate(rows) << FEATURE_BITS) | np.concatenate(buckets))
    return key >> FEATURE_BITS, key & ((1 << FEATURE_BITS) - 1)


def _collect_features(docs: DataFrame, ids: DataFrame, keep: np.ndarray) -> list[np.ndarray]:
    """Features of a bounded sample of documents; ids has at most MAX_POSITIVE or MAX_UNLABELLED rows."""

    def run(batches):
        for batch in batches:
            blobs = []
            for chunk in tv.chunks(batch["text"]):
                row, bucket = _features(chunk, keep)
                cut = np.searchsorted(row, np.arange(chunk.rows + 1))
                blobs += [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], names=["features"])

    one = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = one.select("text").mapInArrow(cm.tidy(run), "features binary")
    return [np.frombuffer(bytes(r[0]), dtype=np.int32) for r in rows.toLocalIterator()]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], vocabulary: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, l1: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights of the vocabulary's buckets and the bias, by full-batch proximal Adam on the nnPU risk."""
    place = np.full(1 << FEATURE_BITS, -1, dtype=np.int64)
    place[vocabulary] = np.arange(len(vocabulary))

    def matrix(docs):
        at = [place[x] for x in docs]
        at = [x[x >= 0] for x in at]
        lengths = np.array([len(x) for x in at], dtype=np.int64)
        return np.concatenate(at) if at else np.zeros(0, np.int64), np.repeat(np.arange(len(at)), lengths), len(at)

    sides = [matrix(positive), matrix(unlabelled)]
    w, b = np.zeros(len(vocabulary)), float(np.log(prior / (1 - prior)))
    m, v, mean = (np.zeros(len(w) + 1) for _ in range(3))

    def push(side, dz):
        cols, rows, _ = side
        return np.append(np.bincount(cols, weights=dz[rows], minlength=len(w)), dz.sum())

    for t in range(1, steps + 1):
        z_p, z_u = (np.bincount(rows, weights=w[cols], minlength=n) + b for cols, rows, n in sides)
        s_p, s_u = (1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (z_p, z_u))
        as_negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        negative = push(sides[1], s_u / len(s_u)) - prior * push(sides[0], s_p / len(s_p))
        positive_side = prior * push(sides[0], (s_p - 1) / len(s_p))
        g = positive_side + negative if as_negative >= 0 else positive_side
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        step = scale * m / (1 - 0.9**t)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * scale[:-1], 0)
        b -= step[-1]
        if t > steps // 2:
            mean += (np.append(w, b) - mean) / (t - steps // 2)
    return mean[:-1], float(mean[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Dense bucket weights and bias, from labels whose crc32(doc_id) % 5 is not 0; None without positives."""
    in_fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    labels = cm.with_columns(labels, doc_id="long", toxic="int").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & in_fold)
    per_doc = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = cm.with_columns(docs, doc_id="long", text="string")
    n, n_toxic = per_doc.agg(F.count("*"), F.sum("toxic")).first()
    if not n_toxic:
        return None
    smallest = F.xxhash64("doc_id")
    p_ids = per_doc.filter("toxic = 1").select("doc_id").orderBy(smallest, "doc_id").limit(MAX_POSITIVE)
    u_ids = docs.filter(in_fold).select("doc_id").distinct().orderBy(smallest, "doc_id").limit(MAX_UNLABELLED)
    positive = _collect_features(docs, p_ids, np.ones(1 << FEATURE_BITS, dtype=bool))
    if not positive:
        return None
    df = np.bincount(np.concatenate(positive), minlength=1 << FEATURE_BITS)
    vocabulary = np.flatnonzero(df >= min(MIN_POSITIVE_DF, len(positive)))
    keep = np.zeros(1 << FEATURE_BITS, dtype=bool)
    keep[vocabulary] = True
    unlabelled = _collect_features(docs, u_ids, keep)
    prior = float(np.clip(n_toxic / n, 1e-3, 0.5))
    w, b = fit(positive, unlabelled, vocabulary, prior)
    dense = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
    dense[vocabulary] = w
    return dense, b


def _scores(batch: pa.RecordBatch, weights: np.ndarray, keep: np.ndarray, bias: float) -> np.ndarray:
    z = np.full(batch.num_rows, bias)
    for chunk in tv.chunks(batch["text"]):
        row, bucket = _features(chunk, keep)
        z[chunk.lo : chunk.hi] += np.bincount(row, weights=weights[bucket], minlength=chunk.rows)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, out: str = "score") -> DataFrame:
    """docs with a score column named out, in place of the input's own of that name; other columns stay as they are."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    dense, bias = model
    used = np.flatnonzero(dense)
    values = dense[used]

    def run(batches):
        weights = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
        weights[used] = values
        keep = weights != 0
        for batch in batches:
            found = pa.array(_scores(batch, weights, keep, bias), pa.float64())
            yield batch.set_column(at, out, found) if at < batch.num_columns else batch.append_column(out, found)

    at = next((k for k, c in enumerate(docs.columns) if c.lower() == out.lower()), len(docs.columns))
    return docs.mapInArrow(cm.tidy(run), docs.withColumn(out, F.lit(0.0)).schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = cm.with_columns(cm.read_table(spark, sf_dir, "documents"), doc_id="long", text="string")
    scored = score(docs, train(docs, cm.read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
