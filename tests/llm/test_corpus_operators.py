import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnstile.llm import common as cm
from turnstile.llm import op4_line_dedup as op4
from turnstile.llm import op5_toxicity as op5
from turnstile.llm import op8_packing as op8
from turnstile.llm import op9_ngram_join as op9

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _brute_components(rows, n, pct):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("options", [{}, {"tile": 3, "near": 2, "salt_at": 5, "hist_bits": 10}])
def test_ngram_join(docs, options):
    want = _brute_components([(r.doc_id, r.text) for r in docs.collect()], 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op9.ngram_jaccard(docs, 4, 85, **options).collect()}
    assert got == want


def test_ngram_join_of_one_large_group(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 100], f"x{i}", *base[i % 100 + 1 :]])) for i in range(150)] + [(1000 + i, " ".join(base)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute_components(rows, 4, 85)
    for options in ({}, {"tile": 20, "near": 5}):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in op9.ngram_jaccard(df, 4, 85, **options).collect()} == want


def test_ngram_join_on_odd_rows(odd, none):
    got = op9.ngram_jaccard(odd)
    assert got.count() == odd.count() and op9.ngram_jaccard(none).count() == 0
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].component_id == 1 and by[4].n_shingles == 0 and by[4].component_id == 4 and by[None].component_id is None
    kept = op9.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8]


def _brute_lines(rows, pct, least):
    lines = []
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(line.translate(LOWER)))
            if len(s) >= least:
                lines.append(((i, k), s))
    return {at for n, (at, s) in enumerate(lines) if any(100 * len(s & t) >= pct * len(s | t) for _, t in lines[:n])}


@pytest.mark.parametrize("options", [{}, {"witnesses": 1, "split_at": 7}])
def test_line_dedup(docs, options):
    want = _brute_lines([(r.doc_id, r.text) for r in docs.collect()], 80, 1)
    assert {tuple(r) for r in op4.repeated_lines(docs, **options).collect()} == want


def test_line_dedup_of_many_variants(spark):
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*base[: i % 25], f"x{i}", *base[i % 25 + 1 :]])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in op4.repeated_lines(df).collect()} == _brute_lines(rows, 80, 1)


@pytest.mark.parametrize("options", [{}, {"split_at": 40}])
def test_line_dedup_when_the_histogram_is_coarse(docs, options):
    """With few buckets the order is poor, the result the same, and no token counts as crowded for its bucket's sake."""
    few = docs.filter("doc_id < 100")
    want = _brute_lines([(r.doc_id, r.text) for r in few.collect()], 80, 1)
    assert {tuple(r) for r in op4.repeated_lines(few, hist_bits=10, **options).collect()} == want


def test_unsettled_lines_meet_all_candidates(spark):
    """Without the bitmap's bound, near misses crowd out the one true match until the further rounds."""
    base = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join([*base[:16], *(f"x{i}y{k}" for k in range(4))])) for i in range(90)]
    rows += [(500, " ".join(base[:16])), (501, "\n".join([" ".join([*base[:15], "z"]), " ".join([*base[:16], "q1", "q2"])]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute_lines(rows, 80, 1)
    assert {tuple(r) for r in op4.repeated_lines(df, witnesses=1).collect()} == want and want


def test_candidates_of_a_large_group_stay_small():
    """12,000 similar lines under one token: 72 million pairs pass through a task in blocks."""
    import resource

    import numpy as np

    n = 12_000
    rng = np.random.default_rng(1)
    head = (7 << 32) | rng.integers(0, 1 << 32, n)
    low = np.zeros(n, np.int64) ^ (np.int64(1) << rng.integers(0, 20, n))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = op4._nearest([head, low, np.full(n, (40 << 16) | 3), np.arange(n), np.zeros(n, np.int64)], 80, 4, None)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert out.num_rows == sum(min(4, i) for i in range(n))


def test_lines_of_a_repeated_document_are_no_copies_of_themselves(spark):
    rows = [(1, "a b c d e f\ng h"), (1, "a b c d e f\ng h"), (2, "x y"), (3, "g h\nnew words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in op4.repeated_lines(df).collect()} == {(3, 0)}


def test_line_dedup_on_odd_rows(odd, none):
    out = op4.remove_lines(odd)
    assert out.columns == odd.columns and op4.remove_lines(none).count() == 0
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert 2 not in texts and 7 not in texts and texts[4] == "" and texts[3] is None and 1 in texts


def test_toxicity_learns(spark, docs, labels):
    out = op5.score(docs, op5.train(docs, labels))
    r = out.join(labels, "doc_id").agg(F.avg(F.when(F.col("toxic") == 1, F.col("score"))), F.avg(F.when(F.col("toxic") == 0, F.col("score")))).first()
    assert r[0] > 0.7 > 0.3 > r[1]


def test_toxicity_holds_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    r = op5.op5_toxicity(spark, d).join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    rate = {x.toxic: x.p for x in r}
    assert rate[1] >= 0.9 and rate[0] < 0.03


def test_risk_against_a_plain_loop():
    """One step from zero weights: the loss's gradient, pair by pair, gives the same signs and size of step."""
    import math

    positive, unlabelled, prior = [[0, 1], [0]], [[1, 2], [2], [0, 2], []], 0.3
    b = math.log(prior / (1 - prior))
    s = 1 / (1 + math.exp(-b))
    negative = sum(-math.log(1 - s) for _ in unlabelled) / 4 - prior * sum(-math.log(1 - s) for _ in positive) / 2
    assert negative > 0
    want = []
    for k in range(3):
        up = prior * sum((s - 1) for d in positive if k in d) / 2
        down = sum(s for d in unlabelled if k in d) / 4 - prior * sum(s for d in positive if k in d) / 2
        want.append(-math.copysign(0.1, up + down))
    import numpy as np

    w, got_b = op5.fit([np.array(d) for d in positive], [np.array(d, dtype=int) for d in unlabelled], np.arange(3), prior, steps=1, l1=0.0)
    assert np.allclose(w, want, atol=1e-4) and got_b != b


def test_nnpu_beats_its_noise():
    import numpy as np

    rng = np.random.default_rng(0)
    make = lambda toxic: np.unique(np.append(rng.integers(10, 400, 60), [1] if toxic else [2]))
    w, b = op5.fit([make(True) for _ in range(200)], [make(i % 10 == 0) for i in range(1000)], np.arange(400), 0.1)
    fresh = lambda toxic: np.mean([w[make(toxic)].sum() + b > 0 for _ in range(200)])
    assert fresh(True) > 0.9 and fresh(False) < 0.05 and w[1] == max(w) and w[2] == min(w)


def test_toxicity_on_odd_rows(spark, odd, none, labels):
    out = op5.score(odd, op5.train(odd, labels), "__s")
    assert out.count() == odd.count() and out.filter("__s BETWEEN 0 AND 1").count() == odd.count()
    # The clashing column score of the input is replaced.
    own = op5.score(odd, op5.train(odd, labels))
    assert own.columns == odd.columns and own.filter("score BETWEEN 0 AND 1").count() == odd.count()
    assert op5.score(none, op5.train(none, labels), "__s").count() == 0
    assert op5.train(odd, labels.limit(0)) is None


def _check_bins(rows, source, text, capacity, per_source):
    bins = defaultdict(list)
    for r in rows:
        if r.bin is not None:
            bins[r.bin].append(r)
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= capacity
        assert max(Counter(source[r.doc_id] for r in b).values()) <= per_source
        assert max(Counter(text[r.doc_id] for r in b).values()) == 1


def test_packing(docs):
    rows = op8.pack(docs, capacity=700, shard_rows=50).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    _check_bins(rows, source, text, 700, 2)
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert all(total[i] == len(WORD.findall(t or "")) for i, t in text.items())


def test_best_fit_takes_the_tightest_compatible_bin():
    p = op8.Packer(100, 1)
    a, b, c = p.add(60, 1, 0), p.add(70, 2, 1), p.add(80, 4, 0)
    assert p.add(20, 8, 0) == c
    assert p.add(25, 16, 1) == a  # the tighter bin holds the same cluster
    assert p.add(25, 2, 0) not in (a, b)


def test_packing_on_odd_rows(odd, none):
    rows = op8.pack(odd, capacity=50)
    assert rows.filter("bin IS NULL").count() == 4 and op8.pack(none).count() == 0
    assert op8.bins(rows).agg(F.max("n_tokens")).first()[0] <= 50


def test_pipeline(spark, docs):
    d = "/root/testdata/sf0.001"
    now = docs
    before = now.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = cm.materialise(stage(spark, now, d))
        assert now.columns == docs.columns, name
        assert now.count() <= before
        before = now.count()
    assert before > 0.5 * docs.count()
    assert len(op9.ngram_jaccard(now).filter("doc_id <> component_id").take(1)) == 0
    bins = corpus_pipeline.packing(spark, now, d)
    assert bins.select(F.explode("doc_ids")).distinct().count() == before
    # A run deletes its own tables only: frames that it did not make stay readable.
    held = op9.ngram_jaccard(docs)
    assert corpus_pipeline.run(spark, d).count() == bins.count()
    assert held.count() == docs.count()


def test_pipeline_on_odd_rows(spark, odd, none):
    d = "/root/testdata/sf0.001"
    rows = none
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = cm.materialise(stage(spark, rows, d))
        assert rows.count() == 0 and rows.columns == none.columns, name
    assert corpus_pipeline.packing(spark, rows, d).count() == 0
    kept = cm.materialise(corpus_pipeline.near_duplicates(spark, cm.materialise(corpus_pipeline.line_dedup(spark, odd, d)), d))
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 4, 5, 6, 8}
    packed = corpus_pipeline.packing(spark, kept, d)
    assert {i for r in packed.collect() for i in r.doc_ids} == {r.doc_id for r in kept.collect() if (r.text or "").split()}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (300, 300)], "a long, b long")
    got = {r.node: r.label for r in cm.components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100}
