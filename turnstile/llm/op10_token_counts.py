"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is pre-split once; blocks of consecutive pre-tokens, with the characters and tokens of each, are the leaves of a
segment tree of sums.  An edit finds its block by descending the tree on characters.  Pre-splitting reads left to
right, has no memory beyond its place, and looks LOOKAHEAD characters past a pre-token's end at most; so it starts anew
at the first pre-token whose view reaches the edit, and stops at the first boundary behind the edit that was one
before.  Only these pre-tokens are encoded again; the sums on the way from their blocks to the root are updated.

Defined results: null text is empty: no tokens before any edit.  Edits beyond the end are held to it.  Extra columns
are ignored; repeated rows each give a row.
"""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from turnstile.llm import common as cm

BLOCK = 64
#: "'ll" and "'re" are tried up to two characters past a lone apostrophe.
LOOKAHEAD = 2
COUNT_CACHE = 400_000


class Counter:
    """Tokens of pre-tokens, remembered (bounded)."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def of(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= COUNT_CACHE:
                self.known.clear()
            self.known[piece] = n
        return n


@cache
def counter(ranks_path: str, pattern: str) -> Counter:
    return Counter(ranks_path, pattern)


class CountTree:
    def __init__(self, text: str, count: Counter):
        self.text, self.count = text, count
        pieces = count.pattern.findall(text)
        self.encoded = len(pieces)
        lengths = list(map(len, pieces))
        known = count.known.get
        tokens = [known(p) or count.of(p) for p in pieces]
        self.blocks = [[lengths[i : i + BLOCK], tokens[i : i + BLOCK]] for i in range(0, len(pieces), BLOCK)] or [[[], []]]
        self.leaves = 1
        while self.leaves < len(self.blocks):
            self.leaves *= 2
        self.chars = [0] * (2 * self.leaves)
        self.tokens = [0] * (2 * self.leaves)
        for k, (a, b) in enumerate(self.blocks):
            self.chars[self.leaves + k], self.tokens[self.leaves + k] = sum(a), sum(b)
        for i in range(self.leaves - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, place: int) -> tuple[int, int, int]:
        """(block, pre-token in it, its first character) of the pre-token that holds the character."""
        i, start = 1, 0
        while i < self.leaves:
            i *= 2
            if place >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        block = min(i - self.leaves, len(self.blocks) - 1)
        lengths = self.blocks[block][0]
        for k, n in enumerate(lengths):
            if place < start + n:
                return block, k, start
            start += n
        return block, len(lengths), start

    def edit(self, place: int, deleted: int, inserted: str) -> None:
        """Replace deleted characters from place on by inserted."""
        place = min(max(place, 0), len(self.text))
        deleted = min(max(deleted, 0), len(self.text) - place)
        old_end, shift = place + deleted, len(inserted) - deleted
        new = self.text[:place] + inserted + self.text[old_end:]
        # The first pre-token that ends within sight of the edit, or one before it.
        block, k, start = self._find(max(place - LOOKAHEAD - 1, 0))
        # Walk the old boundaries and the new ones until they meet behind the edit.
        old_block, old_k, old = block, k, start
        lengths, tokens, at = [], [], start
        match = self.count.pattern.match
        while True:
            while old < at - shift or old < old_end:
                if old_k >= len(self.blocks[old_block][0]):
                    if old_block + 1 >= len(self.blocks):
                        break
                    old_block, old_k = old_block + 1, 0
                    continue
                old += self.blocks[old_block][0][old_k]
                old_k += 1
            if old >= old_end and old + shift == at or at >= len(new):
                break
            m = match(new, at)
            lengths.append(m.end() - at)
            tokens.append(self.count.of(m[0]))
            at = m.end()
        if at >= len(new):
            old_block, old_k = len(self.blocks) - 1, len(self.blocks[-1][0])
        self.encoded += len(lengths)
        first = self.blocks[block]
        rest = [x[old_k:] for x in self.blocks[old_block]]
        if old_block == block:
            self.blocks[block] = [first[0][:k] + lengths + rest[0], first[1][:k] + tokens + rest[1]]
        else:
            self.blocks[block] = [first[0][:k] + lengths, first[1][:k] + tokens]
            for b in range(block + 1, old_block):
                self.blocks[b] = [[], []]
            self.blocks[old_block] = rest
        self.text = new
        touched = set()
        for b in range(block, old_block + 1):
            i = self.leaves + b
            self.chars[i], self.tokens[i] = sum(self.blocks[b][0]), sum(self.blocks[b][1])
            touched.add(i // 2)
        while touched:
            touched.discard(0)
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched if i > 1}


def edits_of(text: str, key: int) -> list[tuple[int, int, str]]:
    """Three edits that the query applies: an insertion, a deletion, and a replacement, placed by the row's key."""
    n = len(text)
    return [((key * 7919) % (n + 1), 0, f" inserted {key % 97} words"), ((key * 104729) % (n + 1), 9, ""), ((key * 1299709) % (n + 1), 4, "'ll be 3x")]


def edited_counts(docs: DataFrame, ranks_path: str, pattern: str, edits=edits_of) -> DataFrame:
    """(doc_id, n_chars, n_pretokens, n_tokens, n_tokens_edited, n_reencoded) of every row."""
    names = ["doc_id", "n_chars", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded"]

    def run(batches):
        count = counter(ranks_path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    tree = CountTree(text or "", count)
                    first, pieces = tree.total, tree.encoded
                    for place, deleted, inserted in edits(tree.text, doc_id or 0):
                        tree.edit(place, deleted, inserted)
                    out.append((doc_id, len(text or ""), pieces, first, tree.total, tree.encoded - pieces))
                yield cm.record_batch(names, list(zip(*out, strict=True)), [pa.int64()] * 6)

    return cm.with_columns(docs, doc_id="long", text="string").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return edited_counts(cm.read_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
