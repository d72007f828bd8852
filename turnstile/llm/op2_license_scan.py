"""License scans: template mark-up compiled to token automata.

A template is wording with regions: ``<<opt>> ... <</opt>>`` may be left out, ``<<any:N>>`` stands for up to N words.
Words are ASCII letters and digits and all beyond ASCII, A-Z lowered.  Each template becomes a nondeterministic token
automaton (one arc a mandatory word, empty arcs around regions, wildcard arcs in replaceable ones); the subset
construction over all templates at once gives one deterministic automaton whose states name the templates accepted
there.  Only a text that holds a template's anchor (its rarest kind of word, named in the table) is walked, from the
words that can begin a template; a text is accepted where the mandatory wording matches word for word.

Beside the templates, base phrases count every place where their words stand consecutively.

Defined results: null text is empty: no words, no labels, score 0.  Score: 1 if a template accepts, else 0.5 if a base
phrase stands in the text, else 0.  Extra columns are ignored; repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnstile.llm import common as cm
from turnstile.llm import textvec as tv

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, anchor, template
TEMPLATES = (
    ("apache-2.0", "apache", "<<opt>>this <<any:3>> is<</opt>> licensed under the apache license <<opt>>version 2 0<</opt>>"),
    ("mit", "mit", "released under the <<opt>>terms of the<</opt>> mit license"),
    ("mit", "mit", "licensed under the <<opt>>terms of the<</opt>> mit license"),
    ("gpl-notice", "gnu", "licensed under the <<opt>>terms of the<</opt>> gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license <<opt>>version <<any:1>><</opt>>"),
    ("cc-notice", "cc", "licensed under <<opt>>a<</opt>> cc by <<opt>>nc<</opt>> <<opt>>sa<</opt>> <<opt>>nd<</opt>> <<any:2>> <<opt>>license<</opt>>"),
    ("cc-notice", "commons", "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> creative commons attribution <<any:6>> license"),
    ("copyright-notice", "reserved", "copyright <<any:8>> all rights reserved"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
)

_MARK = re.compile(r"<<opt>>|<</opt>>|<<any:(\d+)>>|[^\s<>]+")
ANY = None


def parse(template: str) -> list:
    """Nested lists: a word, ("any", n), or ("opt", [...])."""
    stack: list[list] = [[]]
    for m in _MARK.finditer(template):
        if m[0] == "<<opt>>":
            stack.append([])
        elif m[0] == "<</opt>>":
            body = stack.pop()
            stack[-1].append(("opt", body))
        elif m[1]:
            stack[-1].append(("any", int(m[1])))
        else:
            stack[-1].append(m[0])
    if len(stack) != 1:
        raise ValueError(f"unbalanced regions: {template}")
    return stack[0]


class Automaton:
    """Deterministic token automaton of all templates: table[state] maps a word, or ANY for every other, to a state."""

    def __init__(self, templates=TEMPLATES):
        self.arcs: list[list[tuple[str | None, int]]] = []
        self.empty: list[list[int]] = []
        self.final: dict[int, str] = {}
        start = self._node()
        for label, _, template in templates:
            self.final[self._build(parse(template), start)] = label
        self.anchors = frozenset(a for _, a, _ in templates)
        self.table: list[dict] = []
        self.accepts: list[frozenset] = []
        self._determinise(start)
        self.first_words = frozenset(w for w in self.table[0] if w is not ANY)

    def _node(self) -> int:
        self.arcs.append([])
        self.empty.append([])
        return len(self.arcs) - 1

    def _build(self, body: list, at: int) -> int:
        for part in body:
            to = self._node()
            if isinstance(part, str):
                self.arcs[at].append((part, to))
            elif part[0] == "opt":
                self.empty[self._build(part[1], at)].append(to)
                self.empty[at].append(to)
            else:
                self.empty[at].append(to)
                step = at
                for _ in range(part[1]):
                    nxt = self._node()
                    self.arcs[step].append((ANY, nxt))
                    self.empty[nxt].append(to)
                    step = nxt
            at = to
        return at

    def _closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _determinise(self, start: int) -> None:
        first = self._closure([start])
        number, todo = {first: 0}, deque([first])
        while todo:
            states = todo.popleft()
            arcs = [a for s in states for a in self.arcs[s]]
            row = {}
            for word in {w for w, _ in arcs}:
                to = self._closure([t for w, t in arcs if w == word or w is ANY])
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row[word] = number[to]
            self.table.append(row)
            self.accepts.append(frozenset(self.final[s] for s in states if s in self.final))

    def walk(self, words, at: int) -> frozenset:
        """Labels of the templates that accept some run of words beginning at this one."""
        state, found = 0, frozenset()
        for word in words[at:]:
            row = self.table[state]
            state = row.get(word, row.get(ANY))
            if state is None:
                break
            found |= self.accepts[state]
        return found

    def longest(self) -> int:
        """No accepted run has more words than this."""
        depth, layer = 0, {0}
        while layer:
            layer = {t for s in layer for t in self.table[s].values()}
            depth += bool(layer)
        return depth


def _hash_of(words) -> np.ndarray:
    chunk = next(tv.chunks(pa.array([" ".join(words)])))
    return tv.words(chunk, tv.ALNUM, lower=True)[1]


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row a document; the columns are those of the query."""

    def run(batches):
        auto = Automaton(templates)
        longest = auto.longest()
        anchors = np.sort(_hash_of(sorted(auto.anchors)))
        first_words = np.sort(_hash_of(sorted(auto.first_words)))
        phrases = [(_hash_of(p.split()), label) for p, label in BASE.items()]
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for chunk in tv.chunks(batch["text"]):
                spans, h = tv.words(chunk, tv.ALNUM, lower=True)
                n = np.diff(spans.first)
                base: list[list] = [[] for _ in range(chunk.rows)]
                for parts, label in phrases:
                    hit = h[: len(h) - len(parts) + 1] == parts[0] if len(h) >= len(parts) else np.zeros(0, bool)
                    for k in range(1, len(parts)):
                        hit = hit & (h[k : len(h) - len(parts) + 1 + k] == parts[k])
                    at = np.flatnonzero(hit)
                    at = at[spans.row[at] == spans.row[at + len(parts) - 1]]
                    for i, r in zip(at.tolist(), spans.row[at].tolist(), strict=True):
                        base[r].append((i - int(spans.first[r]), label))
                found: dict[int, set] = {}
                rows = np.unique(spans.row[np.isin(h, anchors)])
                if len(rows):
                    starts = np.flatnonzero(np.isin(h, first_words) & np.isin(spans.row, rows))
                    for i, r in zip(starts.tolist(), spans.row[starts].tolist(), strict=True):
                        to = min(i + longest, int(spans.first[r + 1]))
                        words = [bytes(tv.LOWER[chunk.data[a:b]]).decode("utf-8", "replace") for a, b in zip(spans.start[i:to], spans.end[i:to], strict=True)]
                        found.setdefault(r, set()).update(auto.walk(words, 0))
                for r in range(chunk.rows):
                    places = [p for p, _ in base[r]]
                    own = {label for _, label in base[r]}
                    more = found.get(r) or set()
                    cols["n_words"].append(int(n[r]))
                    cols["n_base"].append(len(places))
                    cols["first_word"].append(min(places, default=None))
                    cols["last_word"].append(max(places, default=None))
                    cols["base_labels"].append(",".join(sorted(own)))
                    cols["labels"].append(",".join(sorted(own | more)))
                    cols["score"].append(1.0 if more else 0.5 if own else 0.0)
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols.values(), types, strict=True))], names=["doc_id", *cols])

    return cm.with_columns(docs, doc_id="long", text="string").mapInArrow(run, _OUT)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(cm.read_table(spark, sf_dir, "documents"))


def _pattern(body: list) -> str:
    out = ""
    for part in body:
        if isinstance(part, str):
            out += f"{part} "
        elif part[0] == "opt":
            out += f"(?:{_pattern(part[1])})?"
        else:
            out += f"(?:[^ ]+ ){{0,{part[1]}}}"
    return out


def oracle() -> str:
    """The same by regular expressions over the words joined by spaces."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = []
    for phrase, label in BASE.items():
        cond = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {cond}), lambda i: {{'p': i - 1, 'label': '{label}'}})")
    labels: dict[str, list[str]] = {}
    for label, _, template in TEMPLATES:
        labels.setdefault(label, []).append(_pattern(parse(template)))
    more = ", ".join(f"CASE WHEN {' OR '.join(f"regexp_matches(s, ' {p}')" for p in ps)} THEN '{label}' END" for label, ps in labels.items())
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, list_concat({places[0]}, list_concat({places[1]}, {places[2]})) AS p FROM a),
c AS (SELECT doc_id, w, p, list_filter([{more}], lambda x: x IS NOT NULL) AS m, list_transform(p, lambda x: x.label) AS l FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(p, lambda x: x.p)) AS BIGINT) AS first_word, CAST(list_max(list_transform(p, lambda x: x.p)) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(l)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(l, m))), ','), '') AS labels,
  CASE WHEN len(m) > 0 THEN 1.0::DOUBLE WHEN len(p) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM c"""
