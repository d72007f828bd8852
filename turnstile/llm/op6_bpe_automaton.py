"""BPE encoding and decoding by a compiled token automaton.

The automaton reads tokens and accepts exactly the BPE tokenisations.  It starts from the base symbols, any following
any, and the merges are built in one by one, in rank order.  The gadget of merge (u, v) gives the new token uv a state
with the arcs that v's state has at that moment, adds an arc uv wherever an arc u stands, and takes from u's state the
arc v, with every arc that is added for a token made of v from then on.  Tokens whose states end with the same arcs
share one state.

A state's row of the transition table lists its closed arcs: labels are numbered so that the tokens beginning with a
token follow it, those made last first; what a gadget closes is then one run of labels, and a row is the sorted bounds
of such runs.  (The 49,406 tokens of the file used here have 11,537 states with 1.0 million bounds, 4 MB, compiled in
about a second; as a dense table they would be 70 MB of bits.)  Whether the arc of a label is open is the parity of its
place among the bounds, one binary search; it leads to the label's own state.

Encoding walks a word's characters through the trie of arc labels: at each place, the one token whose arc is open in the
state reached at its beginning is taken; the path to the end of the word is the tokenisation.  Decoding emits the arc
labels.  Pre-splitting follows the vocabulary file: NFC, white space, lower case, its pattern, bytes as printable
characters, a word end on the last.

Defined results: null text is empty: no tokens, and decodes to the empty text.  Extra columns are ignored; repeated
rows each give a row.  Strings of the special tokens are those tokens, as in the library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_left, bisect_right

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from turnstile.llm import common as cm

#: Words that a worker keeps; they only save time.
WORD_CACHE = 400_000


def byte_symbols() -> list[str]:
    """Printable characters for the 256 bytes: themselves where printable in Latin-1, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class TokenAutomaton:
    """Deterministic automaton over tokens; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.labels = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.labels[i] = t
        self.vocab = vocab
        gadgets = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        self._number_labels(gadgets)
        self._compile(gadgets)
        self.length = [len(self._symbols(t)) for t in self.labels]
        self.trie: dict = {}
        for t, i in vocab.items():
            node = self.trie
            for c in self._symbols(t):
                node = node.setdefault(c, {})
            node[None] = i

    @staticmethod
    def _symbols(token: str) -> list[str]:
        """A token's base symbols: characters, the last one with the word end if the token has it."""
        if token.endswith("</w>") and len(token) > 4:
            body = token[:-4]
            return [*body[:-1], body[-1] + "</w>"]
        return list(token)

    def _number_labels(self, gadgets: list[tuple[int, int, int]]) -> None:
        """number: a label's place; end: one behind the last label that begins with it; begun: what begins with it, by
        age; made: the first gadget that makes a token."""
        n = len(self.labels)
        self.made = [-1] * n
        self.begun: list[list[int]] = [[] for _ in range(n)]
        for rank, (u, _, uv) in enumerate(gadgets):
            if self.made[uv] < 0:
                self.made[uv] = rank
                self.begun[u].append(uv)
        self.number, self.end = [0] * n, [0] * n
        at = 0
        for base in range(n):
            stack = [(base, False)] if self.made[base] < 0 else []
            while stack:
                label, left = stack.pop()
                if left:
                    self.end[label] = at
                    continue
                self.number[label] = at
                at += 1
                stack.append((label, True))
                stack += [(x, False) for x in self.begun[label]]

    def _compile(self, gadgets: list[tuple[int, int, int]]) -> None:
        rows = [array("i") for _ in self.labels]
        ages = [[self.made[x] for x in begun] for begun in self.begun]
        for rank, (u, v, uv) in enumerate(gadgets):
            if self.made[uv] == rank:
                rows[uv] = rows[v][:]
            younger = bisect_left(ages[v], rank)
            stop = self.end[self.begun[v][younger]] if younger < len(ages[v]) else self.number[v] + 1
            self._close(rows[u], self.number[v], stop)
        states: dict[bytes, int] = {}
        #: The state that a label's arc leads to, and each state's bounds of closed labels.
        self.state = [states.setdefault(row.tobytes(), len(states)) for row in rows]
        self.rows = [array("i", blob) for blob in states]

    @staticmethod
    def _close(row: array, start: int, stop: int) -> None:
        """Unite the runs of a row with [start, stop)."""
        i, j = bisect_left(row, start), bisect_right(row, stop)
        row[i:j] = array("i", ([start] if i % 2 == 0 else []) + ([stop] if j % 2 == 0 else []))

    def step(self, state: int, label: int) -> int:
        """The state that the label's arc leads to, -1 where it is closed."""
        return -1 if bisect_right(self.rows[state], self.number[label]) & 1 else self.state[label]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """word: printable characters of a pre-split piece, without its word end."""
        symbols = list(word)
        symbols[-1] += "</w>"
        n = len(symbols)
        last: list[int] = [-1] * (n + 1)  # the token that ends at each place on the way there
        trie, rows, state, number = self.trie, self.rows, self.state, self.number
        row = array("i")
        for i in range(n):
            if i:
                if last[i] < 0:
                    continue
                row = rows[state[last[i]]]
            node = trie
            for j in range(i, n):
                node = node.get(symbols[j])
                if node is None:
                    break
                t = node.get(None)
                if t is not None and last[j + 1] < 0 and not bisect_right(row, number[t]) & 1:
                    last[j + 1] = t
        out, at = [], n
        while at > 0:
            t = last[at]
            out.append(t)
            at -= self.length[t]
        return tuple(out[::-1])


@functools.cache
def codec_of(path: str) -> WordBpe:
    """One codec a worker process."""
    return WordBpe(path)


class WordBpe:
    """Encoder and decoder of a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = TokenAutomaton(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])
        self.labels = list(self.automaton.labels)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.labels += [""] * (i + 1 - len(self.labels))
            self.labels[i] = t
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.words: dict[str, tuple[int, ...]] = {}

    def normalise(self, text: str) -> str:
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        # Character by character: str.lower() alone knows a final sigma.
        return text.replace("Σ", "σ").lower()

    def _word(self, piece: str) -> tuple[int, ...]:
        ids = self.automaton.encode_word("".join([self.symbols[b] for b in piece.encode("utf-8")]))
        if len(self.words) >= WORD_CACHE:
            self.words.clear()
        self.words[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        parts = self.split.split(text) if any(s in text for s in self.special) else [text]
        get = self.words.get
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.pieces.findall(self.normalise(part)):
                out += get(piece) or self._word(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """Arc labels, spaced: the file names no decoder."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row."""
    return _with_codec(docs, path, "doc_id long, ids array<int>, decoded string", lambda ids, text: (ids, text), [pa.list_(pa.int32()), pa.string()])


def _with_codec(docs: DataFrame, path: str, schema: str, make, types) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for text in part["text"].to_pylist():
                    ids = codec.encode(text or "")
                    out.append(make(ids, codec.decode(ids)))
                cols = list(zip(*out, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return cm.with_columns(docs, doc_id="long", text="string").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    return _with_codec(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids), sha(" ".join(map(str, ids))), sha(text)), [pa.int64(), pa.string(), pa.string()])


def op6_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(cm.read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
