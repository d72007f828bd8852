"""Vectorised tokenising and hashing of Arrow text columns.

Texts stay in their UTF-8 buffer; word bounds and 64-bit word hashes come from whole-buffer numpy
passes, so a row costs no Python loop.  A null text is an empty text.  A text is never cut: a chunk
holds whole rows, and a row larger than the chunk target makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; bounds the memory of the numpy passes (about 40 bytes per byte of text).
CHUNK_BYTES = 1 << 20

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15 | 1)
_MULT_INV = _U(pow(int(_MULT), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_CODES_LOWER = _BYTE_CODES[LOWER]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Bytes of words: all but the given closed ranges of separators."""
    out = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = False
    return out


#: ``[^\x20\x09-\x0D]+``: runs of anything but ASCII white space.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over text with A-Z lowered: ASCII alphanumerics and all beyond ASCII.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 2 * CHUNK_BYTES)
        for name, m in (("pw", _MULT), ("inv", _MULT_INV)):
            table = np.full(size, m, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
        _powers["n"] = size
    return _powers["pw"], _powers["inv"]


@dataclass
class Chunk:
    """Whole rows ``lo..hi`` of a batch: their bytes and each row's bounds in them."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray  # rows + 1 offsets into data

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def chunks(texts: pa.Array | pa.ChunkedArray, target: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, side="right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Spans:
    """Runs of a byte class (or lines): row of the chunk, byte bounds, and where each row's runs begin."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # rows + 1 offsets into the arrays above


def _by_row(chunk: Chunk, start: np.ndarray, end: np.ndarray) -> Spans:
    first = np.searchsorted(start, chunk.bounds[:-1], side="left")
    first = np.append(first, len(start))
    row = np.repeat(np.arange(chunk.rows), np.diff(first))
    return Spans(row, start, end, first)


def _translated(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for a table of 256 bytes, several times as fast."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), dtype=np.uint8)


def runs(chunk: Chunk, member: np.ndarray) -> Spans:
    """Maximal runs of bytes of the class within each row."""
    n = len(chunk.data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Spans(empty, empty, empty, np.zeros(chunk.rows + 1, np.int64))
    inside = _translated(chunk.data, member).view(bool)
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    turns = np.concatenate([[0] if inside[0] else [], turns, [n] if inside[-1] else []]).astype(np.int64)
    start, end = turns[::2], turns[1::2]
    # A run that goes on over the end of a row is two.
    edges = np.unique(chunk.bounds[(chunk.bounds > 0) & (chunk.bounds < n)])
    edges = edges[inside[edges] & inside[edges - 1]]
    if len(edges):
        start, end = np.sort(np.append(start, edges)), np.sort(np.append(end, edges))
    return _by_row(chunk, start, end)


def lines(chunk: Chunk) -> Spans:
    """Lines split at newline, empty ones included; an empty row has one empty line."""
    breaks = np.flatnonzero(chunk.data == 10)
    start = np.concatenate([chunk.bounds[:-1], breaks + 1])
    end = np.concatenate([chunk.bounds[1:], breaks])
    row = np.concatenate([np.arange(chunk.rows), np.searchsorted(chunk.bounds, breaks, side="right") - 1])
    # A row's end belongs to its last line: order starts and ends apart within each row.
    by_start, by_end = np.lexsort((start, row)), np.lexsort((end, row))
    first = np.append(0, np.cumsum(np.bincount(row, minlength=chunk.rows)))
    return Spans(row[by_start], start[by_start], end[by_end], first)


def prefix_hash(chunk: Chunk, lower: bool = False) -> np.ndarray:
    """Prefix sums of the polynomial hash; see span_hash."""
    pw, _ = _power_tables(len(chunk.data) + 1)
    codes = (_BYTE_CODES_LOWER if lower else _BYTE_CODES)[chunk.data]
    codes *= pw[: len(codes)]
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: equal ranges have equal hashes wherever they stand."""
    _, inv = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


#: Words up to so many bytes are hashed eight bytes at a time, longer ones by span_hash.
SHORT = 64


def words(chunk: Chunk, member: np.ndarray = SPACED, lower: bool = False) -> tuple[Spans, np.ndarray]:
    """Words and their 64-bit hashes; a word's hash depends on its bytes alone."""
    spans = runs(chunk, member)
    data = np.zeros(len(chunk.data) + 8, dtype=np.uint8)
    data[: len(chunk.data)] = _translated(chunk.data, LOWER) if lower else chunk.data
    eights = np.ndarray((len(chunk.data) + 1,), dtype="<u8", buffer=data, strides=(1,))
    left = spans.end - spans.start
    out = left.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    at, live = spans.start, None
    for step in range(SHORT // 8):
        # Bytes beyond the word are shifted out.
        block = eights[at] << (_U(8) * np.maximum(8 - left, 0).astype(np.uint64))
        if live is None:
            out = mix(out ^ block)
        else:
            out[live] = mix(out[live] * _MULT ^ block)
        more = left > 8
        if step + 1 == SHORT // 8 or not more.any():
            break
        live = np.flatnonzero(more) if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    long = np.flatnonzero(spans.end - spans.start > SHORT)
    if len(long):
        out[long] = span_hash(prefix_hash(chunk, lower), spans.start[long], spans.end[long])
    return spans, out


_GRAM = mix(np.arange(1000, 1064, dtype=np.uint64)) | _U(1)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row, a shorter non-empty row giving its whole sequence once.

    Returns the hashes in row order and where each row's begin.
    """
    counts = np.diff(first)
    take = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_first = np.append(0, np.cumsum(take))
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, np.uint64), out_first
    at = np.arange(total) + np.repeat(first[:-1] - out_first[:-1], take)
    length = np.repeat(np.minimum(counts, k), take)
    acc = length.astype(np.uint64) * _GRAM[0]
    for j in range(k):
        live = j < length
        acc += np.where(live, hashes[np.minimum(at + j, len(hashes) - 1)], _U(0)) * _GRAM[j + 1]
    return mix(acc), out_first
