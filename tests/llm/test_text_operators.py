import hashlib
import random

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
import re
from tokenizers import Tokenizer

from turnstile.llm import op1_quality_rules as op1
from turnstile.llm import op2_license_scan as op2
from turnstile.llm import op3_url_filter as op3
from turnstile.llm import op6_bpe_automaton as op6
from turnstile.llm import op7_ctph as op7
from turnstile.llm import op10_token_counts as op10
from turnstile.llm import registry
from turnstile.llm import textvec as tv

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    assert oracle.differences(registry.QUERIES[name](spark, SF), registry.ORACLES[name], oracle.connect(SF)) == []


def test_words_and_lines():
    texts = ["", None, "a", " Éa  b\n\nc ", "x" * 50, "\n"]
    chunks = list(tv.chunks(pa.array(texts), target=8))
    assert sum(c.rows for c in chunks) == len(texts)
    for c in chunks:
        spans, hashes = tv.words(c, tv.SPACED)
        lines = tv.lines(c)
        for r in range(c.rows):
            t = texts[c.lo + r] or ""
            own = slice(spans.first[r], spans.first[r + 1])
            assert [bytes(c.data[a:b]).decode() for a, b in zip(spans.start[own], spans.end[own], strict=True)] == WORD.findall(t)
            own = slice(lines.first[r], lines.first[r + 1])
            assert [bytes(c.data[a:b]).decode() for a, b in zip(lines.start[own], lines.end[own], strict=True)] == t.split("\n")
    one = tv.words(next(tv.chunks(pa.array(["The the THE zzz"]))), tv.SPACED, lower=True)[1]
    assert len(set(one.tolist())) == 2 and one[0] == one[1] == one[2]


def test_quality_rules_on_odd_rows(spark, odd, none, labels):
    got = op1.quality_rules(odd, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (6, None)], "doc_id long, quality int"))
    assert got.count() == odd.count() and got.filter("kept IS NULL").count() == 0
    assert got.filter("doc_id = 3").first().n_words == 0
    assert op1.quality_rules(none, labels).count() == 0
    assert op1.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(0, 10), (3, 10), (40, 1000)], "k long, n long").select(op1.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect()
    assert np.allclose([r.p for r in got], [0.598736939, 0.998971, 0.0797], atol=2e-3)


def test_cutoffs_need_evidence(spark):
    counted = spark.createDataFrame([(i, "en", 100, 500, 400 if i % 50 == 0 else 0, 0, 0, 10, 0, 0) for i in range(3000)], "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_shouts long")
    labels = counted.selectExpr("doc_id", "1 AS quality")
    cuts = {r["rule"]: r.cutoff for r in op1.cutoffs(counted, labels).collect()}
    # Two in a hundred good documents lie at 800 thousandths: no cutoff at or below that is certified.
    assert cuts["symbols"] > 800 and cuts["repeats"] == 10
    assert op1.cutoffs(counted, labels.limit(100)).count() == 0


def test_license_scan_on_odd_rows(odd, none):
    assert op2.scan(odd).count() == odd.count() and op2.scan(none).count() == 0


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("This fine work is Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("licensed under the apache license", "apache-2.0"),
        ("licensed under an apache license", ""),
        ("Released under the terms of the MIT license", "mit"),
        ("released under the old MIT license", ""),
        ("Copyright 2020 by the authors. All rights reserved.", "copyright-notice,reserved"),
        ("CC BY", "cc-by"),
    ],
)
def test_templates(spark, text, label):
    assert op2.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == label


def test_url_rules(spark, none):
    urls = [("http://a.com/en/x", "com/en/", "block"), ("https://WWW.Example.com/en/77?x", "example.com/en/7", "allow"), ("http://example.net/de/8", "example.net/de/8", "block"), ("http://n.net/de/", "net/de/", "allow"), ("http://badcom/en/", None, "allow"), ("http://spam-farm.org/", None, "block"), (None, None, "allow"), ("no scheme", None, "allow"), ("://", None, "allow")]
    pages = spark.createDataFrame([(i, u, 1) for i, (u, _, _) in enumerate(urls)], "page_id long, url string, rule int")
    got = {r.page_id: (r.rule, r.verdict) for r in op3.judge(pages).collect()}
    assert got == {i: (rule, v) for i, (_, rule, v) in enumerate(urls)}
    assert op3.judge(pages.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_literal():
    filed = op3.index(op3.RULES, {"example": 5, "com": 9, "en": 7})
    assert [r.name for r in filed["example"]] == ["example.com/en/7"] or "com/en/" in [r.name for r in filed["en"]]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(library):
    codec = op6.codec_of(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    alphabet = list("aaabbcdeehhilnnoorstt' 's'll  12\t\n.,!?éÉΣß中½") + ["ΑΣ", "İ", "́", "\x85", "\x1c", "<|endoftext|>", "hahaha"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_arcs_are_those_of_plain_merging():
    """Every pair of tokens of a small vocabulary: the arc is open just if merging their text gives them back."""
    rng = random.Random(4)
    for _ in range(30):
        tokens, merges = list("abc"), []
        while len(merges) < 14:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        ranks = {m: r for r, m in enumerate(merges)}

        def merged(text):
            parts = list(text)
            while True:
                best = min((ranks.get(p, 99), i) for i, p in enumerate([*zip(parts, parts[1:], strict=False), ("", "")]))
                if best[0] == 99:
                    return parts
                u, v = merges[best[0]]
                out, i = [], 0
                while i < len(parts):
                    if parts[i : i + 2] == [u, v]:
                        out.append(u + v)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out

        whole = [t for t in tokens if merged(t) == [t]]
        a = op6.TokenAutomaton({t: i for i, t in enumerate(tokens)}, merges)
        for u in whole:
            for v in whole:
                got = a.step(a.state[a.vocab[u]], a.vocab[v])
                assert (got >= 0) == (merged(u + v) == [u, v]), (merges, u, v)
                assert got in (-1, a.state[a.vocab[v]])


def test_bpe_query(spark, docs, odd, none, library):
    path = public_tokenizers.path("word_bpe_49k.json")
    sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()

    def plain(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    key = lambda r: (r[0] is None, r)
    for df, got in ((docs, op6.op6_bpe_automaton(spark, SF)), (odd, op6.digests(odd, path))):
        assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=key) == sorted((plain(r.doc_id, r.text) for r in df.collect()), key=key)
    assert op6.digests(none, path).count() == 0


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng = random.Random(2)
    a = ["".join(rng.choice("ABCab+/") for _ in range(rng.randint(0, 64))) for _ in range(200)]
    b = [x[2:] + "A" if rng.random() < 0.5 else "".join(rng.choice("ABCab+/") for _ in range(rng.randint(0, 63))) for x in a]
    assert op7.edit_distances(a, b).tolist() == [_levenshtein(x, y) for x, y in zip(a, b, strict=True)]


def test_fingerprints_against_a_plain_pass(docs, monkeypatch):
    monkeypatch.setattr(op7, "RANGE_ROWS", 37)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in op7.next_document_likeness(docs).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), op7.fingerprint(text), op7.fingerprint(edited))
        assert g.near_next == op7.likeness([g.fingerprint], [op7.fingerprint(after)])[0]
        assert g.near_edited == op7.likeness([g.fingerprint], [g.edited_fingerprint])[0]


def test_fingerprints_of_odd_rows(spark, odd, none):
    assert op7.next_document_likeness(odd).count() == odd.count() and op7.next_document_likeness(none).count() == 0
    one = op7.next_document_likeness(spark.createDataFrame([(1, "abcdef" * 30)], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(3000))
    moved = "something new in front " + text
    assert op7.likeness([op7.fingerprint(text)], [op7.fingerprint(moved)])[0] > 0.8


def test_counts_after_edits():
    count = op10.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    alphabet = list("ab  c'\n\n sltrevmd12.,!é中") + ["'ll", "  ", "\n ", "'re"]
    for _ in range(600):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 20, 900])))
        tree = op10.CountTree(text, count)
        for _ in range(4):
            p, d = rng.randint(0, len(text) + 2), rng.choice([0, 1, 5, 200])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 6])))
            at = min(p, len(text))
            text = text[:at] + new + text[at + d :]
            before = tree.encoded
            tree.edit(p, d, new)
            assert tree.text == text and tree.chars[1] == len(text)
            assert tree.total == len(count.encoding.encode_ordinary(text))
            assert tree.encoded - before < 40 + len(new)


def test_count_query_on_odd_rows(odd, none):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert op10.edited_counts(odd, path, pattern).count() == odd.count() and op10.edited_counts(none, path, pattern).count() == 0
