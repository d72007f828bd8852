"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash of the last 7 bytes ends a chunk where it is block_size - 1 modulo the block size, so boundaries follow
the content and an edit changes nearby chunks only.  Each chunk gives one of 64 characters; the fingerprint is
"block:signature:signature at twice the block".  Block sizes are 3 * 2**k, about a 64th of the text's bytes, halved
while the signature is short.  Fingerprints are comparable if a block size is the same or twice the other's: likeness
is then 1 - 2 * edit distance / (both lengths), held to 0 where no run of 4 characters is shared.  Edit distances run
bit-parallel (Myers), a 64-bit word a pair and a batch of pairs at a time.

op7 pairs each document with the next one by descending doc_id.  Documents are dealt by doc_id ranges; each range also
gets the first document of the next one, so no task holds more than a range and no global sort meets in one task.

Defined results: null text is empty; its fingerprint is "3::", like only to its equal.  Null doc_ids come last; rows of
equal doc_id are ordered by text.  The last document's next is the first; a lone document's next is itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm import common as cm
from turnstile.llm import textvec as tv

WINDOW = 7
LONGEST = 64
SHORT = 32
RUN = 4
#: Documents of an id range, and the most ranges there are (their bounds pass the driver).
RANGE_ROWS = 500
MAX_RANGES = 10_000
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_ROLL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646C | 1, 0xFD7046C5)]
_LOW = -(1 << 63)


def _signature(prefix: np.ndarray, ends: np.ndarray, n: int) -> str:
    """A character for each chunk; what follows the 63rd end, or the last, is one more chunk."""
    ends = ends[: LONGEST - 1]
    start = np.append(0, ends)
    end = np.append(ends, n)
    if start[-1] == n:
        start, end = start[:-1], end[:-1]
    return _ALPHABET[(tv.span_hash(prefix, start, end) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(raw)
    if not n:
        return "3::"
    h = np.zeros(n, dtype=np.uint32)
    wide = raw.astype(np.uint32) + np.uint32(1)
    for j, m in enumerate(_ROLL[:WINDOW]):
        if j < n:
            h[j:] += wide[: n - j] * m
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    third = np.flatnonzero(h % np.uint32(3) == 2)
    q = (h[third] // np.uint32(3)).astype(np.int64)  # h % (3 << k) == (3 << k) - 1 iff h % 3 == 2 and q ends in k ones
    k = 0
    while (3 << k) * LONGEST < n:
        k += 1
    while k and np.count_nonzero((q & ((1 << k) - 1)) == (1 << k) - 1) < SHORT:
        k -= 1
    chunk = tv.Chunk(0, 1, raw, np.array([0, n]))
    prefix = tv.prefix_hash(chunk)
    one, two = (_signature(prefix, third[(q & ((1 << j) - 1)) == (1 << j) - 1] + 1, n) for j in (k, k + 1))
    return f"{3 << k}:{one}:{two}"


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of signatures of at most 64 characters, all pairs at once."""
    rows = len(a)
    la, lb = (np.array([len(x) for x in s], dtype=np.int64) for s in (a, b))
    code = np.zeros(256, dtype=np.int64)
    code[_ALPHABET] = np.arange(64)
    peq = np.zeros((rows, 64), dtype=np.uint64)
    owner = np.repeat(np.arange(rows), la)
    place = np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(la)[:-1]), la)
    symbols = code[np.frombuffer("".join(a).encode(), dtype=np.uint8)]
    np.bitwise_or.at(peq, (owner, symbols), np.uint64(1) << place.astype(np.uint64))
    text = np.zeros((rows, int(lb.max(initial=0))), dtype=np.int64)
    owner = np.repeat(np.arange(rows), lb)
    text[owner, np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(lb)[:-1]), lb)] = code[np.frombuffer("".join(b).encode(), dtype=np.uint8)]
    pv, mv, dist = np.full(rows, ~np.uint64(0)), np.zeros(rows, np.uint64), la.copy()
    top = np.maximum(la - 1, 0).astype(np.uint64)
    one, every = np.uint64(1), np.arange(rows)
    for j in range(text.shape[1]):
        eq = peq[every, text[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        live = j < lb
        dist += np.where(live, ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64), 0)
        ph, mh = (ph << one) | one, mh << one
        pv, mv = np.where(live, mh | ~(xv | ph), pv), np.where(live, ph & xv, mv)
    return np.where(la == 0, lb, dist)


def _runs_of(s: str, k: int) -> set[str]:
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness in 0..1 of pairs of fingerprints; incompatible block sizes are 0, equal fingerprints 1."""
    out = np.zeros(len(a))
    left, right, owner = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[i] = 1.0
            continue
        bx, x1, x2 = x.split(":")
        by, y1, y2 = y.split(":")
        bx, by = int(bx), int(by)
        for s, t in ((x1, y1), (x2, y2)) if bx == by else ((x2, y1),) if 2 * bx == by else ((x1, y2),) if bx == 2 * by else ():
            k = min(RUN, len(s), len(t))
            if k and not _runs_of(s, k).isdisjoint(_runs_of(t, k)):
                left.append(s)
                right.append(t)
                owner.append(i)
    if left:
        d = edit_distances(left, right)
        total = np.array([len(s) + len(t) for s, t in zip(left, right, strict=True)])
        np.maximum.at(out, owner, np.clip(1 - 2 * d / total, 0, 1))
    return out


def _ranged(docs: DataFrame) -> tuple[DataFrame, list[int]]:
    """Rows with the number of their id range (the highest ids in range 0), and once more, as tail, in the range before."""
    n = docs.count()
    ranges = int(min(MAX_RANGES, max(1, n // RANGE_ROWS)))
    ids = docs.select("doc_id")
    bounds: list[int] = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 4 * ranges)).first()[0] or []))
    edges = np.array(bounds, dtype=np.int64)

    def number(ids: pa.Array) -> np.ndarray:
        return len(edges) - np.searchsorted(edges, pc.fill_null(ids, _LOW).to_numpy(zero_copy_only=False), side="left")

    def heads_of(batches):
        best: dict[int, int] = {}
        for b in batches:
            filled = pc.fill_null(b["doc_id"], _LOW).to_numpy(zero_copy_only=False)
            for r, i in zip(number(b["doc_id"]).tolist(), filled.tolist(), strict=True):
                best[r] = max(best.get(r, _LOW), i)
        yield cm.record_batch(["range", "head"], [list(best), list(best.values())], [pa.int32(), pa.int64()])

    heads = dict(ids.mapInArrow(heads_of, "range int, head long").groupBy("range").agg(F.max("head")).collect())
    order = sorted(heads)
    before = {r: order[k - 1] for k, r in enumerate(order)}  # the first range's first follows the last range's last

    def place(batches):
        for b in batches:
            r = number(b["doc_id"])
            filled = pc.fill_null(b["doc_id"], _LOW).to_numpy(zero_copy_only=False)
            again = [i for i, (x, d) in enumerate(zip(r.tolist(), filled.tolist(), strict=True)) if d == heads[x]]
            take = np.append(np.arange(b.num_rows), again).astype(np.int64)
            at = np.append(r, [before[int(r[i])] for i in again]).astype(np.int32)
            tail = np.append(np.zeros(b.num_rows, bool), np.ones(len(again), bool))
            rows = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(tail), rows["doc_id"], rows["text"]], names=["range", "tail", "doc_id", "text"])

    placed = docs.mapInArrow(place, "range int, tail boolean, doc_id long, text string")
    return placed.repartition("range").sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), "text"), order


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def next_document_likeness(docs: DataFrame) -> DataFrame:
    docs = cm.with_columns(docs, doc_id="long", text="string")
    rows, _ = _ranged(docs)

    def report(done):
        """done: (doc_id, text, fingerprint, next text, next fingerprint)"""
        ids, chars, shas, prints, edited_prints = [], [], [], [], []
        for doc_id, text, fp, following, _ in done:
            n = len(text)
            edited = text[: n - n // 2] + following[: n // 2]
            ids.append(doc_id)
            chars.append(n)
            shas.append(hashlib.sha256(edited.encode("utf-8")).hexdigest())
            prints.append(fp)
            edited_prints.append(fingerprint(edited) if n > 1 else fp)
        cols = [ids, chars, shas, prints, edited_prints, likeness(prints, edited_prints), likeness(prints, [d[4] for d in done])]
        return cm.record_batch([c.split()[0] for c in _OUT.split(", ")], cols, _TYPES)

    def run(batches):
        last, closed = None, None  # the row that waits for its next; the range whose tail has come
        done = []
        for b in batches:
            for r, tail, doc_id, text in zip(b["range"].to_pylist(), b["tail"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                if tail and (last is None or last[0] != r):
                    continue
                text = text or ""
                fp = fingerprint(text)
                if last is not None and last[0] == r:
                    done.append((last[1], last[2], last[3], text, fp))
                last = None if tail else (r, doc_id, text, fp)
                if len(done) >= 500:
                    yield report(done)
                    done = []
        if done:
            yield report(done)

    return rows.mapInArrow(run, _OUT)


def op7_ctph(spark, sf_dir: str) -> DataFrame:
    return next_document_likeness(cm.read_table(spark, sf_dir, "documents"))
