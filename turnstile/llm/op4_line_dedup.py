"""Line dedup: exact set-similarity join over lines, later matches removed.

A line's set holds the 64-bit hashes of its distinct words, A-Z lowered.  Tokens are ordered by rarity, read from a
fixed-size histogram of all lines (any one global order is exact).  Two sets at Jaccard >= t share a token among their
n - ceil(t n) + 1 rarest ones; those prefixes meet by token, where the length filter, the positional filter and a
96-bit parity bitmap leave few pairs; these are verified on the words themselves.  (A bit counts the set's tokens of one hash
class modulo two, so two bitmaps differ in at most as many bits as the sets differ in tokens, however long the lines.)
Lines are ordered by (doc_id, line number).  A line goes if an earlier line of the corpus has an equal set, or is
similar to it, whether or not that earlier line itself stays.

Equal sets are found by a 128-bit name, first within each task, then across them.  Under a token they collapse to their first line, in the task that scans them
and again where they meet, so copies make no pairs.  A posting is five longs, sorted by one of them.

Of a line's candidates under one token the WITNESSES nearest by bitmap are kept, a number that grows MORE-fold in
each further round for the few lines that none of them settled and that had more, until none is left: no cap.  Tokens
of more than SPLIT_AT different sets are set aside where they are met (found exactly, not estimated) and dealt out to
cells of bounded size.  The lines to verify are found again by a scan with a membership mask, so whole texts are never
shuffled.

Sets of very few words (n/(n+1) below the similarity: under four at 0.8) can be similar to equal sets only, which are
found by name, so their prefixes stay out of the join.

Defined results: null text is empty; a line with fewer than min_tokens distinct words always stays, by default only one
without words; rows without doc_id are left alone and match nothing; rows that repeat a doc_id count as one document.
Extra columns pass through remove_lines().  A document that loses every line with words has no text left and is dropped
there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm import common as cm
from turnstile.llm import textvec as tv

PCT = 80
MIN_TOKENS = 1
WITNESSES = 4
MORE = 256
#: Different sets under one token that one task compares.
SPLIT_AT = 100_000
#: Postings looked at together; bounds a task's memory along with SPLIT_AT.
GATHER = 100_000
#: Pairs whose filters are computed at a time.
PAIR_BLOCK = 1 << 18
#: Crowded tokens whose numbers of cells are sent to every task (16 bytes each); more are joined.
FEW_TOKENS = 100_000
#: Sizes and places from here on are not told apart; the filters let them pass.
LARGE = 0xFFFF


class _Lines:
    """Distinct words of each line of a chunk, the rarest first where a histogram is given.

    With wanted, only of the lines it marks, given the words' lines and hashes and each line's row and number.
    """

    def __init__(self, chunk: tv.Chunk, hist: np.ndarray | None, min_tokens: int, wanted=None):
        spans, hashes = tv.words(chunk, tv.SPACED, lower=True)
        line = tv.lines(chunk)
        owner = np.searchsorted(line.start, spans.start, side="right") - 1
        if wanted is not None:
            marks = wanted(owner, hashes, line.row, np.arange(len(line.row)) - line.first[line.row])
            some = marks[owner]
            owner, hashes = owner[some], hashes[some]
        uniq, inverse = np.unique(hashes, return_inverse=True)
        place = cm.rank_by_rarity(hist, uniq) if hist is not None else np.arange(len(uniq))
        by_place = np.empty(len(uniq), dtype=np.uint64)
        by_place[place] = uniq
        keys = np.sort((owner.astype(np.int64) << 32) | place[inverse])
        if len(keys):
            keys = keys[np.append(True, keys[1:] != keys[:-1])]
        owners = keys >> 32
        self.tokens = by_place[keys & 0xFFFFFFFF]
        first = np.searchsorted(owners, np.arange(len(line.row)))
        size = np.diff(np.append(first, len(keys)))
        kept = np.flatnonzero(size >= min_tokens)
        self.first, self.size, self.row = first[kept], size[kept], line.row[kept]
        self.number = (kept - line.first[line.row[kept]]).astype(np.int64)

    def names(self, seed: int = 0) -> np.ndarray:
        """64 bits that equal sets share; another seed gives 64 others."""
        total = np.append(np.uint64(0), np.cumsum(tv.mix(self.tokens ^ np.uint64(seed))))
        return tv.mix((total[self.first + self.size] - total[self.first]) ^ self.size.astype(np.uint64)).view(np.int64)

    def tokens_of(self, i: int) -> np.ndarray:
        return self.tokens[self.first[i] : self.first[i] + self.size[i]]

    def parities(self, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64 bits, 32 bits) of the lines named: parities of the tokens of 96 hash classes."""
        size = self.size[take]
        starts = np.cumsum(size) - size
        tokens = self.tokens[np.arange(int(size.sum())) + np.repeat(self.first[take] - starts, size)]
        place = (tokens >> np.uint64(32)) * np.uint64(96) >> np.uint64(32)
        bit = np.uint64(1) << (place & np.uint64(63))
        low, high = (np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), starts) for half in (place < 64, place >= 64))
        return low.view(np.int64), high.view(np.int64)


#: A slice of the task's histogram; or a line: with its set's name the first of its set in the task, without a later one.
_PROFILE = "name long, name2 long, doc_id long, line int, slice int, counts binary"


def _profile(min_tokens: int, hist_bits: int):
    names = [c.split()[0] for c in _PROFILE.split(", ")]

    def run(batches):
        counts = np.zeros(1 << hist_bits, dtype=np.uint32)
        lines: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids = pc.fill_null(batch["doc_id"], 0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            for chunk in tv.chunks(batch["text"]):
                x = _Lines(chunk, None, min_tokens)
                np.add.at(counts, cm.bucket(x.tokens, len(counts)), np.uint32(1))
                rows = x.row + chunk.lo
                some = known[rows]
                lines.append(tuple(c[some] for c in (x.names(), x.names(1), ids[rows], x.number.astype(np.int32))))
        slices, blobs = cm.hist_rows(counts)
        none = pa.nulls(len(slices), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(slices), pa.int32()), pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], names=names)
        if not lines:
            return
        name, name2, doc, line = (np.concatenate(c) for c in zip(*lines, strict=True))
        order = np.lexsort((line, doc, name2, name))
        name, name2, doc, line = name[order], name2[order], doc[order], line[order]
        if not len(name):
            return
        new = np.append(True, (name[1:] != name[:-1]) | (name2[1:] != name2[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
        # Rows that repeat a doc_id have lines at the same place; none of them is later.
        later = (doc != doc[first]) | (line != line[first])
        for lo in range(0, len(name), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            n = len(name[part])
            yield pa.RecordBatch.from_arrays([pa.array(name[part], mask=later[part]), pa.array(name2[part], mask=later[part]), pa.array(doc[part]), pa.array(line[part]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)

    return cm.tidy(run)


#: head: 32 bits of the token and of the set's name; low, rest: 64 and 32 parities, and the size and the place in the
#: set, 16 bits each.  96 parities and 32 bits name a set.  Long runs of zeros stand together, which packs well.
_POST = ["head", "low", "rest", "doc_id", "line"]
_POST_SQL = ", ".join(f"{c} long" for c in _POST)


def _key(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(32)).astype(np.uint32).view(np.int32).astype(np.int64)


def _postings(hist: np.ndarray, pct: int, min_tokens: int, mask: bytes | None = None):
    """Prefix tokens (those in the mask, if any) of each line whose set the task has not seen at an earlier place."""

    def run(batches):
        seen: dict[int, tuple[int, int]] = {}
        bits = None if mask is None else cm.open_mask(mask)

        def holding(owner, hashes, row, number):
            marks = np.zeros(len(row), dtype=bool)
            marks[owner[cm.in_mask(bits, [pa.array(_key(hashes))])]] = True
            return marks

        for batch in batches:
            ids = pc.fill_null(batch["doc_id"], 0).to_numpy(zero_copy_only=False)
            known = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            for chunk in tv.chunks(batch["text"]):
                # Only sets that a different one can be similar to: the nearest has one token more.
                x = _Lines(chunk, hist, max(min_tokens, -(-pct // (100 - pct)) if pct < 100 else 1), None if bits is None else holding)
                rows = x.row + chunk.lo
                name = x.names()
                take = []
                for i, (own, doc, line, ok) in enumerate(zip(name.tolist(), ids[rows].tolist(), x.number.tolist(), known[rows].tolist(), strict=True)):
                    if ok and ((before := seen.get(own)) is None or (doc, line) < before):
                        seen[own] = (doc, line)
                        take.append(i)
                if not take:
                    continue
                take = np.array(take, dtype=np.int64)
                low, high = x.parities(take)
                size = x.size[take]
                reach = size + (-pct * size // 100) + 1
                owner = np.repeat(np.arange(len(take)), reach)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach)
                key = _key(x.tokens[x.first[take][owner] + at])
                if bits is not None:
                    asked = cm.in_mask(bits, [pa.array(key)])
                    owner, at, key = owner[asked], at[asked], key[asked]
                head = key << 32 | (name[take] & 0xFFFFFFFF)[owner]
                rest = (high << 32 | np.minimum(size, LARGE) << 16)[owner] | np.minimum(at, LARGE)
                yield cm.record_batch(_POST, [head, low[owner], rest, ids[rows[take]].astype(np.int64)[owner], x.number[take][owner]], [pa.int64()] * 5)

    return cm.tidy(run)


def _firsts(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Postings by token, size, place and name, those of equal sets reduced to the earliest line's."""
    head, low, rest, doc, line = cols[:5]
    stand, name = head >> 32 << 32 | rest & 0xFFFFFFFF, head & 0xFFFFFFFF

    def same(order):
        return np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in (head, rest, low)])

    order = np.lexsort((name, stand))
    if same(order).any():
        order = np.lexsort((line, doc, rest, low, name, stand))
        order = order[np.append(True, ~same(order))]
    return [c[order] for c in cols]


def _nearest(cols: list[np.ndarray], pct: int, witnesses: int, asked: np.ndarray | None) -> pa.RecordBatch | None:
    """Each line's nearest earlier candidates under each token of whole groups of postings.

    cols may end with a cell's two salts and the row's own: then only pairs are made that no other cell makes.
    """
    cols = _firsts(cols)
    head, low, rest, doc, line = cols[:5]
    key, high, n, at = head >> 32, rest >> 32 & 0xFFFFFFFF, rest >> 16 & 0xFFFF, rest & 0xFFFF
    rows = np.arange(len(key))
    group = np.append(0, np.cumsum(key[1:] != key[:-1]))
    lo = np.searchsorted(group << 17 | n, group << 17 | -(-pct * n // 100))
    reach = rows - lo
    done = np.append(0, np.cumsum(reach))
    kept, waiting = [], 0

    def trimmed(parts: list[np.ndarray], most: int) -> np.ndarray:
        """Packed (later row, differing bits, earlier row), the first few of each later row."""
        packed = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        if not len(packed):
            return packed
        start = np.flatnonzero(np.append(True, packed[1:] >> 32 != packed[:-1] >> 32))
        rank = np.arange(len(packed)) - np.repeat(start, np.diff(np.append(start, len(packed))))
        return packed[rank < most]

    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(done, done[start] + PAIR_BLOCK, side="right")) - 1)
        i = np.repeat(rows[start:stop], reach[start:stop])
        j = np.arange(len(i)) - np.repeat(done[start:stop] - done[start], reach[start:stop]) + np.repeat(lo[start:stop], reach[start:stop])
        start = stop
        if len(cols) > 5:
            a, b, own = cols[5:]
            apart = (a[i] == b[i]) | (own[i] != own[j])
            i, j = i[apart], j[apart]
        total = n[i] + n[j]
        need = -(-pct * total // (100 + pct))
        differ = np.bitwise_count((low[i] ^ low[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((high[i] ^ high[j]).view(np.uint64))
        ok = ((total - differ) // 2 >= need) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need) | (n[i] == LARGE)
        i, j, differ = i[ok], j[ok], differ[ok]
        i_later = (doc[j] < doc[i]) | ((doc[j] == doc[i]) & (line[j] < line[i]))
        later, earlier = np.where(i_later, i, j), np.where(i_later, j, i)
        other = (doc[i] != doc[j]) | (line[i] != line[j])
        if asked is not None:
            other &= cm.in_mask(asked, [pa.array(doc[later]), pa.array(line[later])])
        kept.append(trimmed([(later << 32 | differ << 24 | earlier)[other]], witnesses + 1))
        waiting += len(kept[-1])
        if waiting > PAIR_BLOCK:
            kept = [trimmed(kept, witnesses + 1)]
            waiting = len(kept[0]) // 2
    found = trimmed(kept, witnesses + 1)
    if not len(found):
        return None
    later, earlier = found >> 32, found & 0xFFFFFF
    start = np.flatnonzero(np.append(True, later[1:] != later[:-1]))
    count = np.diff(np.append(start, len(later)))
    keep = np.arange(len(later)) - np.repeat(start, count) < witnesses
    more = np.repeat(count, count) > witnesses
    later, earlier, differ, more = later[keep], earlier[keep], (found >> 24 & 0xFF)[keep], more[keep]
    columns = [doc[later], line[later], doc[earlier], line[earlier], differ, pa.array(key[later], mask=~more)]
    return cm.record_batch(_FOUND, [np.zeros(len(later), np.int32), *columns], [pa.int32(), *[pa.int64()] * 6])


#: kind 0: a candidate (doc_id, line, by_doc, by_line, differ, the token's key if there were more); kind 1: a posting.
_FOUND = ["kind", "c0", "c1", "c2", "c3", "c4", "c5"]
_FOUND_SQL = "kind int, c0 long, c1 long, c2 long, c3 long, c4 long, c5 long"


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _meet(pct: int, witnesses: int, split_at: int, mask: bytes | None):
    """Candidates among postings that come sorted by head; postings of tokens with more sets than split_at go on."""

    def aside(cols):
        n = len(cols[0])
        return cm.record_batch(_FOUND, [np.ones(n, np.int32), *cols, np.zeros(n, np.int64)], [pa.int32(), *[pa.int64()] * 6])

    def run(batches):
        asked = None if mask is None else cm.open_mask(mask)
        held: list[list[np.ndarray]] = []
        waiting, crowded = 0, None
        for batch in batches:
            held.append(_numbers(batch, _POST))
            waiting += batch.num_rows
            if waiting < min(GATHER, 2 * split_at):
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            key = cols[0] >> 32
            if crowded is not None:
                to = int(np.searchsorted(key, crowded, side="right"))
                if to:
                    yield aside([c[:to] for c in cols])
                if to < len(key):
                    crowded = None
                cols = [c[to:] for c in cols]
                key = key[to:]
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield from _groups([c[:cut] for c in cols], split_at, aside, asked)
            cols = [c[cut:] for c in cols]
            if len(cols[0]) > split_at:
                cols = _firsts(cols)
                if len(cols[0]) > split_at:
                    crowded = int(key[-1])
                    yield aside(cols)
                    cols = [c[:0] for c in cols]
            held, waiting = [cols], len(cols[0])
        if waiting:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            if crowded is not None:
                to = int(np.searchsorted(cols[0] >> 32, crowded, side="right"))
                yield aside([c[:to] for c in cols])
                cols = [c[to:] for c in cols]
            if len(cols[0]):
                yield from _groups(cols, split_at, aside, asked)

    def _groups(cols, split_at, aside, asked):
        key = cols[0] >> 32
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        large = np.repeat(size > split_at, size)
        if large.any():
            yield aside([c[large] for c in cols])
            cols = [c[~large] for c in cols]
        if len(cols[0]):
            out = _nearest(cols, pct, witnesses, asked)
            if out is not None:
                yield out

    return cm.tidy(run)


def _meet_in_cells(pct: int, witnesses: int, mask: bytes | None):
    """The same among the postings of crowded tokens, which come sorted by token and cell."""
    names = [*_POST, "a", "b", "own"]

    def run(batches):
        asked = None if mask is None else cm.open_mask(mask)
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_numbers(batch, names))
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            edge = (cols[0][1:] >> 32 != cols[0][:-1] >> 32) | (cols[5][1:] != cols[5][:-1]) | (cols[6][1:] != cols[6][:-1])
            cuts = [0, *(np.flatnonzero(edge) + 1).tolist()]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                out = _nearest([c[lo:hi] for c in cols], pct, witnesses, asked)
                if out is not None:
                    yield out
            held = [[c[cuts[-1] :] for c in cols]]
        if held:
            out = _nearest(held[0], pct, witnesses, asked)
            if out is not None:
                yield out

    return cm.tidy(run)


def _candidates(docs: DataFrame, hist: np.ndarray, pct: int, min_tokens: int, witnesses: int, split_at: int, tokens: bytes | None = None, lines: bytes | None = None) -> DataFrame:
    """(doc_id, line, near, more): a line's nearest candidates and the tokens under which there were others."""
    posts = docs.mapInArrow(_postings(hist, pct, min_tokens, tokens), _POST_SQL)
    found = cm.materialise(posts.repartition(F.shiftright("head", 32)).sortWithinPartitions("head").mapInArrow(_meet(pct, witnesses, split_at, lines), _FOUND_SQL))
    near = found.filter("kind = 0")
    crowded = found.filter("kind = 1")
    if crowded.limit(1).count():
        key = F.shiftright("head", 32)
        # A token's sets are dealt to pairs of salts, so that each two of them meet in one cell.
        posts = crowded.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(_POST)))
        salts = cm.materialise(posts.groupBy(key.alias("of")).agg(F.ceil(F.count("*") / split_at).alias("salts")))
        few = salts.count() <= FEW_TOKENS
        dealt = posts.join(F.broadcast(salts) if few else salts, key == F.col("of")).withColumn("own", F.pmod(F.xxhash64("low"), "salts"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        dealt = dealt.select(*_POST, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")
        cells = dealt.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b", "head")
        near = near.unionByName(cells.mapInArrow(_meet_in_cells(pct, witnesses, lines), _FOUND_SQL))
    near = near.select(F.col("c0").alias("doc_id"), F.col("c1").cast("int").alias("line"), F.struct(F.col("c4").alias("differ"), F.col("c2").alias("by_doc"), F.col("c3").cast("int").alias("by_line")).alias("by"), "c5")
    out = cm.materialise(near.groupBy("doc_id", "line").agg(F.array_sort(F.collect_set("by")).alias("near"), F.collect_set("c5").alias("more")))
    cm.discard(found)
    return out


def _line_texts(documents: bytes, mask: bytes):
    """The bytes of the lines that the mask holds, in the documents that their mask holds."""

    def run(batches):
        of_docs, bits = cm.open_mask(documents), cm.open_mask(mask)
        for batch in batches:
            batch = batch.filter(pa.array(cm.in_mask(of_docs, [batch["doc_id"]])))
            ids = batch["doc_id"]
            for chunk in tv.chunks(batch["text"]):
                line = tv.lines(chunk)
                number = np.arange(len(line.row)) - line.first[line.row]
                own = ids.take(pa.array(line.row + chunk.lo))
                take = np.flatnonzero(cm.in_mask(bits, [own, pa.array(number)]) & own.is_valid().to_numpy(zero_copy_only=False))
                if len(take):
                    data = chunk.data.tobytes()
                    texts = [data[x:y] for x, y in zip(line.start[take].tolist(), line.end[take].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(take)), pa.array(number[take], pa.int32()), pa.array(texts, pa.binary())], names=["doc_id", "line", "words"])

    return cm.tidy(run)


def _similar(pct: int):
    """bytes.lower and bytes.split know ASCII alone: the words are those of the join, compared as they stand."""

    def run(batches):
        for batch in batches:
            hit = []
            for i, (a, b) in enumerate(zip(batch["words"].to_pylist(), batch["by_words"].to_pylist(), strict=True)):
                x, y = set(a.lower().split()), set(b.lower().split())
                both = len(x & y)
                if both and 100 * both >= pct * (len(x) + len(y) - both):
                    hit.append(i)
            if hit:
                at = pa.array(hit)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["line"].take(at)], names=["doc_id", "line"])

    return cm.tidy(run)


def _settled(docs: DataFrame, found: DataFrame, pct: int) -> DataFrame:
    """(doc_id, line) of the lines of found that one of their candidates is similar to."""
    pairs = found.select("doc_id", "line", F.explode("near").alias("by")).select("doc_id", "line", "by.by_doc", "by.by_line")
    ends = found.select("doc_id", "line").unionByName(pairs.select(F.col("by_doc").alias("doc_id"), F.col("by_line").alias("line")).distinct())
    documents = cm.member_mask(ends.select("doc_id").distinct())
    texts = cm.materialise(docs.mapInArrow(_line_texts(documents, cm.member_mask(ends)), "doc_id long, line int, words binary"))
    # Both sides read the same columns of the same table, so that it is dealt out once.
    x, y = texts.alias("x"), texts.alias("y")
    both = pairs.alias("p").join(x, (F.col("p.doc_id") == F.col("x.doc_id")) & (F.col("p.line") == F.col("x.line")))
    both = both.join(y, (F.col("by_doc") == F.col("y.doc_id")) & (F.col("by_line") == F.col("y.line")))
    both = both.select("p.doc_id", "p.line", F.col("x.words").alias("words"), F.col("y.words").alias("by_words"))
    out = cm.materialise(both.mapInArrow(_similar(pct), "doc_id long, line int").distinct())
    cm.discard(texts)
    return out


def repeated_lines(docs: DataFrame, pct: int = PCT, min_tokens: int = MIN_TOKENS, witnesses: int = WITNESSES, split_at: int = SPLIT_AT, hist_bits: int = cm.HIST_BITS) -> DataFrame:
    """(doc_id, line) of the lines that repeat an earlier one."""
    docs = cm.with_columns(docs, doc_id="long", text="string")
    scan = cm.materialise(docs.mapInArrow(_profile(min_tokens, hist_bits), _PROFILE))
    hist = cm.merge_hist(scan.filter("slice is not null").select("slice", "counts"), hist_bits)
    # A set has a row a task here, however often its lines are repeated.
    lines = scan.filter("slice is null")
    in_set = Window.partitionBy("name", "name2").orderBy("doc_id", "line")
    across = lines.filter("name is not null").withColumn("place", F.rank().over(in_set)).filter("place > 1")
    copies = cm.materialise(lines.filter("name is null").select("doc_id", "line").unionByName(across.select("doc_id", "line")))
    cm.discard(scan)

    asked = _candidates(docs, hist, pct, min_tokens, witnesses, split_at)
    similar = []
    while True:
        similar.append(_settled(docs, asked, pct))
        unsettled = cm.materialise(asked.filter(F.size("more") > 0).join(similar[-1], ["doc_id", "line"], "left_anti").select("doc_id", "line", "more"))
        cm.discard(asked)
        if not unsettled.limit(1).count():
            break
        witnesses *= MORE
        tokens = cm.member_mask(unsettled.select(F.explode("more").alias("key")).distinct())
        found = _candidates(docs, hist, pct, min_tokens, witnesses, split_at, tokens, cm.member_mask(unsettled.select(F.col("doc_id"), F.col("line").cast("long").alias("line"))))
        asked = cm.materialise(found.join(unsettled.select("doc_id", "line"), ["doc_id", "line"], "left_semi"))
        cm.discard(found)
    for part in similar:
        copies = copies.unionByName(part)
    return copies.distinct()


def per_document(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """(__removed_doc, __gone): the removed line numbers of each document that has any."""
    return removed.groupBy(F.col("doc_id").alias("__removed_doc")).agg(F.array_sort(F.collect_set("line")).alias("__gone"))


def remove_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the repeated lines; documents left without words are dropped; n_chars, if any, is counted anew."""
    gone = cm.materialise(per_document(docs, repeated_lines(docs, **options)))
    mask = cm.member_mask(gone.select("__removed_doc"))
    touched = cm.masked(docs, mask, "doc_id")
    joined = touched.join(gone, touched["doc_id"] == gone["__removed_doc"], "left")
    kept = F.concat_ws("\n", F.filter(F.split(F.col("text"), "\n"), lambda x, i: ~F.array_contains("__gone", i)))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    columns = [F.col("__text").alias(c) if c == "text" else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    changed = joined.withColumn("__text", text).filter(F.col("__gone").isNull() | (F.translate(F.col("__text"), " \t\n\x0b\f\r", "") != "")).select(*columns)
    return cm.masked(docs, mask, "doc_id", inside=False).unionByName(changed)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = cm.with_columns(cm.read_table(spark, sf_dir, "documents"), doc_id="long", text="string")
    gone = cm.materialise(per_document(docs, repeated_lines(docs)))
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    counted = docs.select("doc_id", n_lines.alias("n_lines"))
    out = counted.join(gone, counted.doc_id == gone["__removed_doc"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("__gone", F.array().cast("array<int>")).alias("removed_lines"))
