"""Line dedup takes lines of any number of distinct words, in the query and in the pipeline's stage."""

import re

import pytest

from turnstile.llm import op4_line_dedup as op4

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def _brute(rows, pct):
    lines = []
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(line.translate(LOWER)))
            if s:
                lines.append(((i, k), s))
    return {at for n, (at, s) in enumerate(lines) if any(100 * len(s & t) >= pct * len(s | t) for _, t in lines[:n])}


@pytest.fixture(scope="module")
def short(spark):
    lines = ["All rights reserved.", "all rights RESERVED.", "go", "go go go go go go", "a b", "b a", "a b c", "a b c d", "a b c d e", "e d c b", "x y z w v", "w x y z", "", " ", "the the the end of the end"]
    rows = [(i, "\n".join([lines[i % len(lines)], f"own{i}", lines[(7 * i + 3) % len(lines)]])) for i in range(45)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("pct", [50, 75, 80])
def test_short_lines(short, pct):
    rows, df = short
    assert {tuple(r) for r in op4.repeated_lines(df, pct).collect()} == _brute(rows, pct)


def test_stage_removes_short_lines(short):
    rows, df = short
    gone = _brute(rows, 80)
    want = {}
    for i, t in rows:
        left = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        if WORD.search(" ".join(left)):
            want[i] = "\n".join(left)
    assert {r.doc_id: r.text for r in op4.remove_lines(df).collect()} == want


def test_query_removes_short_lines(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {(r.doc_id, k) for r in op4.op4_line_dedup(spark, SF).collect() for k in r.removed_lines}
    assert got == _brute(rows, 80)
