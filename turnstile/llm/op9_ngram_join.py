"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Equal sets collapse to one representative, so
copies cost a row each and no comparison.  Candidates come from the prefix principle: two sets at Jaccard >= t share
one of their n - ceil(t n) + 1 rarest grams, rarity being read from a fixed-size histogram (any one global order is
exact; common passages sort last, so they pull nobody together).  Under each gram, sets stand by size; each is paired
with the sets of the size band before it, at most NEAR of them, and a pair stays if the two bitmaps allow the overlap
it needs.  Where a gram's band holds more, all its sets are tied to one of them instead.  What is tied or paired forms
blocks.  A block's documents meet in tiles of bounded size, keyed by size band, where bitmaps bound each overlap from
above before sorted arrays are intersected.  Blocks beyond one tile first meet tile by tile with a pivot tile; tile
pairs already joined into one component are then skipped, all others compared.  So no link is lost, and a group's
pairs are not written out.

Defined results: null or empty text, or text without words: an empty set, linked with nothing, component its own
doc_id.  Fewer than n words: the whole sequence is the one gram.  Rows that share a doc_id count as one document;
rows without doc_id keep a null component.  Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm import common as cm
from turnstile.llm import textvec as tv

#: Documents in a tile, and grams in all its sets (8 bytes each); its bitmaps take about one byte a gram.
TILE = 1024
TILE_GRAMS = 4_000_000
#: Bits of the smallest bitmap; larger sets get 2 bits a gram and more, 4 in tiles.
BITMAP = 512
#: Neighbours that a set is paired with under one gram; beyond them the gram's sets are tied.
NEAR = 48
#: Sets under one gram that a single sort key takes before it is salted; at least one in HEAVY of all documents.
SALT_AT = 200_000
HEAVY = 4096
#: Grams are counted so many at a time, by name only where at least one in SEEN_OFTEN of those documents holds the gram.
COUNT_GRAMS = 500_000
SEEN_OFTEN = 64


def _sets(batches, n: int, id_col: str = "doc_id"):
    """(batch, row, sorted distinct gram hashes) of each row."""
    for batch in batches:
        for chunk in tv.chunks(batch["text"]):
            spans, hashes = tv.words(chunk, tv.SPACED, lower=True)
            grams, first = tv.grams(hashes, spans.first, n)
            for r in range(chunk.rows):
                g = np.sort(grams[first[r] : first[r + 1]])
                if len(g) > 1:
                    g = g[np.append(True, g[1:] != g[:-1])]
                yield batch, chunk.lo + r, g


def _signature(s: np.ndarray, seed: int = 0) -> int:
    """64-bit name of a set; 0 is kept for the empty set.  Another seed gives 64 further bits."""
    if not len(s):
        return 0
    x = int(np.sum(tv.mix(s ^ np.uint64(len(s) + (seed << 48))), dtype=np.uint64))
    return (x or 1) - (1 << 64) if x >= 1 << 63 else (x or 1)


#: A document's row; or, with a slice, a slice of the task's histogram; or, with slice -1, a gram (sig) and its count (n).
_PROFILE = "doc_id long, sig long, sig2 long, n long, bits binary, slice int, counts binary"


def _profile(n: int, hist_bits: int):
    names = [c.split()[0] for c in _PROFILE.split(", ")]

    def run(batches):
        counts = np.zeros(1 << hist_bits, dtype=np.uint32)
        seen: set[int] = set()

        def counted(heap):
            grams = np.sort(np.concatenate(heap))
            np.add.at(counts, cm.bucket(grams, len(counts)), np.uint32(1))
            start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            times = np.diff(np.append(start, len(grams)))
            often = np.flatnonzero(times >= max(2, len(heap) // SEEN_OFTEN))
            k = len(often)
            if k:
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(grams[start[often]].view(np.int64)), none, pa.array(times[often], pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.full(k, -1, np.int32)), pa.nulls(k, pa.binary())], names=names)

        for batch in batches:
            sizes, sigs, more, maps = [], [], [], []
            heap, held = [], 0
            for _, _, s in _sets([batch], n):
                sizes.append(len(s))
                sigs.append(_signature(s))
                more.append(_signature(s, 1))
                maps.append(bitmap(s, bitmap_bits(len(s))).tobytes() if len(s) else None)
                if sigs[-1] not in seen:
                    seen.add(sigs[-1])
                    heap.append(s)
                    held += len(s)
                    if held > COUNT_GRAMS:
                        yield from counted(heap)
                        heap, held = [], 0
            if heap:
                yield from counted(heap)
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sigs, pa.int64()), pa.array(more, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        slices, blobs = cm.hist_rows(counts)
        none = pa.nulls(len(slices), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(slices), pa.binary()), pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return cm.tidy(run)


def _heavy(scan: DataFrame, salt_at: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted grams, salts) of the grams that very many sets hold, each gram counted by itself.

    A gram counted here is in at least one of HEAVY documents, so their number is bounded by HEAVY times a document's
    mean number of grams.  Counts may fall short, never exceed: they deal out rows and decide no link.
    """
    most = max(salt_at, scan.filter("slice is null").count() // HEAVY)
    rows = scan.filter("slice = -1").groupBy("sig").agg(F.sum("n").alias("n")).filter(F.col("n") > most).collect()
    grams = np.array([r.sig for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.array([(r.n - 1) // most + 1 for r in rows], dtype=np.int64)[order]


def prefix_length(n: int, pct: int) -> int:
    return n - -(-pct * n // 100) + 1


def _postings(n: int, pct: int, hist: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]):
    """A row per prefix gram of each set first seen by the task; copies beyond the first add nothing."""
    names, types = ["key", "salt", "n", "sig"], [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    known, split = heavy

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, salts, sizes, sigs = [], [], [], []
            for _, _, s in _sets([batch], n):
                sig = _signature(s)
                if not sig or sig in seen:
                    continue
                seen.add(sig)
                take = np.argsort(hist[cm.bucket(s, len(hist))], kind="stable")[: prefix_length(len(s), pct)]
                keys.append(s[take].view(np.int64))
                salt = np.full(len(take), -1)
                if len(known):
                    place = np.minimum(np.searchsorted(known, s[take]), len(known) - 1)
                    salt = np.where(known[place] == s[take], (sig & 0x7FFFFFFF) % split[place], -1)
                salts.append(salt)
                sizes.append(np.full(len(take), len(s)))
                sigs.append(np.full(len(take), sig))
            if keys:
                yield cm.record_batch(names, [np.concatenate(x) for x in (keys, salts, sizes, sigs)], types)

    return cm.tidy(run)


def _band(n: np.ndarray, pct: int) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(100 / pct)).astype(np.int64)


PAIR, TIE, LEAD = 0, 1, 2


def _neighbours(pct: int, slack: int, near: int):
    """Rows sorted by gram (and salt) and size: pairs of close neighbours, ties through crowded bands, band leads.

    A salted gram's sets are always tied, and one of each band leads on to where the salts meet.
    """
    names, types = ["kind", "a", "b", "n"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "salt", "n", "sig")]
            fresh = 0 if carried is None else len(carried[0])
            if carried is not None:
                cols = [np.append(t, x) for t, x in zip(carried, cols, strict=True)]
            key, salt, n, sig = cols
            rows = np.arange(len(key))
            new = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
            group = np.cumsum(new) - 1
            span = int(n.max()) + 1
            lo = np.searchsorted(group * span + n, group * span - (-(pct**slack) * n // 100**slack))
            # Rows with more before them than that, and salted or second-round ones, are tied through their whole band.
            crowded = (rows - lo > near) | (salt >= 0) | (slack > 1)
            reach = np.where(crowded | (rows < fresh), 0, rows - lo)
            i = np.repeat(rows, reach)
            j = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(lo, reach)
            marks = np.zeros(len(rows) + 1, dtype=np.int64)
            np.add.at(marks, lo[crowded] + 1, 1)
            np.add.at(marks, rows[crowded] + 1, -1)
            tied = np.cumsum(marks)[:-1] > 0
            # A run begins with the row before its first tied one; all of it is tied to its smallest name.
            start = np.flatnonzero(~tied)
            hub = np.repeat(np.minimum.reduceat(sig, start), np.diff(np.append(start, len(rows))))
            alone = np.append(~tied[1:], True) & ~tied
            c = np.flatnonzero(~alone)
            band = _band(n, pct)
            lead = np.flatnonzero((salt >= 0) & (new | np.append(True, band[1:] != band[:-1])) & (rows >= fresh))
            kinds = []
            for kind, x, y in ((PAIR, sig[i], sig[j]), (TIE, sig[c], hub[c])):
                ends = np.stack([np.minimum(x, y), np.maximum(x, y)], 1)
                ends = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
                kinds.append((np.full(len(ends), kind), ends[:, 0], ends[:, 1], np.zeros(len(ends), np.int64)))
            kinds.append((np.full(len(lead), LEAD), key[lead], sig[lead], n[lead]))
            out = [np.concatenate(x) for x in zip(*kinds, strict=True)]
            if len(out[0]):
                yield cm.record_batch(names, out, types)
            # A window of more rows than near is tied as a whole, which the last of them show as well as all.
            carried = [x[max(min(int(lo[-1]), len(rows) - 1), len(rows) - near - 1) :] for x in cols]

    return cm.tidy(run)


_KINDS = "kind int, a long, b long, n long"


def bitmap_bits(n: int) -> int:
    return max(BITMAP, 1 << int(2 * n).bit_length())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, dtype=np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def similar(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    if pct * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= pct * (len(x) + len(y) - both)


def tile_links(sets: list[np.ndarray], pct: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a tile's sets, every pair of different trees being bounded or compared."""
    find, union = cm.union_find(len(sets))
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], dtype=np.int64)
    bits = bitmap_bits(2 * int(size.max(initial=1)))
    maps = np.stack([bitmap(sets[i], bits) for i in order]) if order else np.zeros((0, 1), np.uint64)
    out = []
    for at, i in enumerate(order):
        # Sizes within the ratio: a run just before this one in size order.
        lo = int(np.searchsorted(size, -(-pct * size[at] // 100)))
        if lo >= at:
            continue
        total = size[lo:at] + size[at]
        need = -(-pct * total // (100 + pct))
        # |x ^ y| is at least the bits that differ, so the overlap is at most (total - differing) / 2.
        differ = cm.popcount(maps[lo:at] ^ maps[at]).sum(axis=1, dtype=np.int64)
        hopeful = np.flatnonzero((total - differ) // 2 >= need)
        for k in hopeful[np.argsort(differ[hopeful], kind="stable")]:
            j = order[lo + k]
            if find(i) == find(j):
                continue
            if similar(sets[i], sets[j], pct):
                union(i, j)
                out.append((i, j))
    return out


def _tiles(n: int, pct: int):
    """Links of each tile; rows come sorted by tile, and a tile holds two tiles' documents at most."""

    def flush(ids, sets):
        if len(ids) > 1:
            links = tile_links(sets, pct)
            if links:
                yield cm.record_batch(["a", "b"], [[ids[i] for i, _ in links], [ids[j] for _, j in links]], [pa.int64(), pa.int64()])

    def run(batches):
        now, ids, sets = None, [], []
        for batch, r, s in _sets(batches, n):
            tile = batch["tile"][r].as_py()
            if tile != now:
                yield from flush(ids, sets)
                now, ids, sets = tile, [], []
            ids.append(batch["doc_id"][r].as_py())
            sets.append(s)
        yield from flush(ids, sets)

    return cm.tidy(run)


def _folded(bits: bytes, to: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bits, dtype=np.uint64).reshape(-1, to // 64), axis=0)


def _possible(pct: int):
    """Pairs whose bitmaps allow the overlap: a bit that only one has is a gram that only it has."""

    def run(batches):
        for batch in batches:
            keep = []
            for k, (x, y, n, m) in enumerate(zip(batch["x"], batch["y"], batch["n"].to_pylist(), batch["m"].to_pylist(), strict=True)):
                x, y = x.as_py(), y.as_py()
                to = 8 * min(len(x), len(y))
                p, q = _folded(x, to), _folded(y, to)
                most = min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))
                if 100 * most >= pct * (n + m - most):
                    keep.append(k)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch["a"].take(at), batch["b"].take(at)], names=["a", "b"])

    return cm.tidy(run)


def _bounded(pairs: DataFrame, heads: DataFrame, pct: int) -> DataFrame:
    one = heads.select(F.col("sig").alias("a"), F.col("bits").alias("x"), "n")
    two = heads.select(F.col("sig").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(_possible(pct), "a long, b long")


def _meet(docs: DataFrame, places: DataFrame, n: int, pct: int) -> DataFrame:
    """places: (doc_id, tile); the documents of a tile are compared in one task."""
    # Only texts that may have a place are dealt out.
    some = cm.masked(docs, cm.member_mask(places.select("doc_id")), "doc_id")
    rows = some.join(places, "doc_id").select("tile", "doc_id", "text")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(n, pct), "a long, b long")


def ngram_jaccard(docs: DataFrame, n: int = 5, pct: int = 80, tile: int = TILE, salt_at: int = SALT_AT, near: int = NEAR, hist_bits: int = cm.HIST_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links are 100 * intersection >= pct * union."""
    docs = cm.with_columns(docs, doc_id="long", text="string")
    scan = cm.materialise(docs.mapInArrow(_profile(n, hist_bits), _PROFILE))
    hist = cm.merge_hist(scan.filter("slice >= 0").select("slice", "counts"), hist_bits)
    meta = scan.filter("slice is null").select("doc_id", "sig", "sig2", "n", "bits")
    heads = cm.materialise(meta.filter("sig <> 0").groupBy("sig", "sig2").agg(F.min("doc_id").alias("head"), F.min("n").alias("n"), F.any_value("bits").alias("bits")).filter("head is not null"))

    posts = docs.mapInArrow(_postings(n, pct, hist, _heavy(scan, salt_at)), "key long, salt int, n int, sig long")
    first = cm.materialise(posts.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "sig").mapInArrow(_neighbours(pct, 1, near), _KINDS))
    pairs = cm.materialise(_bounded(first.filter(F.col("kind") == PAIR).select("a", "b").distinct(), heads, pct))
    leads = first.filter(F.col("kind") == LEAD).select(F.col("a").alias("key"), F.lit(-1).alias("salt"), "n", F.col("b").alias("sig"))
    second = leads.repartition("key").sortWithinPartitions("key", "n", "sig").mapInArrow(_neighbours(pct, 2, near), _KINDS)
    ties = first.unionByName(second).filter(F.col("kind") == TIE).select("a", "b").distinct()
    links = _inside_blocks(docs, heads, cm.materialise(pairs.unionByName(ties)), n, pct, tile)
    labels = cm.components(links)
    named_sets = cm.materialise(heads.join(labels, heads["head"] == labels.node, "left").select("sig", "sig2", F.coalesce("label", "head").alias("component")))
    return meta.join(named_sets, ["sig", "sig2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _inside_blocks(docs: DataFrame, heads: DataFrame, edges: DataFrame, n: int, pct: int, tile: int) -> DataFrame:
    """Links inside the blocks that pairs and ties of set names make."""
    blocks = cm.components(edges)
    members = heads.join(blocks, heads.sig == blocks.node).select(F.col("head").alias("doc_id"), "n", F.col("label").alias("block"))
    members = cm.materialise(members.withColumn("band", F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(math.log(100 / pct))).cast("long")))
    load = F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / TILE_GRAMS))
    per_block = members.groupBy("block").agg(load.alias("in_block"))
    per_band = members.groupBy("block", F.col("band").alias("of_band")).agg(load.alias("cuts")).withColumnRenamed("block", "of_block")
    sized = cm.materialise(per_band.join(per_block, per_band.of_block == per_block.block).select("of_block", "of_band", "cuts", "in_block"))
    placed = members.join(sized, (members.block == sized.of_block) & (members.band == sized.of_band))
    placed = cm.materialise(placed.select("doc_id", "block", "band", "cuts", (F.col("in_block") > 1).alias("large"), F.pmod(F.xxhash64("doc_id"), F.col("cuts")).alias("cut")))

    def named(*parts) -> F.Column:
        return F.concat_ws("/", *(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))

    one = placed.filter("not large").select("doc_id", named(F.col("block")).alias("tile"))
    large = placed.filter("large")
    # Pivot round: each tile with the first tile of its band; each first tile with the next band's first tile.
    hosts = F.when(F.col("cut") == 0, F.concat(F.transform(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda c: named(F.col("block"), F.col("band"), c)), F.array(named(F.col("block"), F.col("band"), "up"), named(F.col("block"), F.col("band") - 1, "up")))).otherwise(F.array(named(F.col("block"), F.col("band"), F.col("cut"))))
    pivots = large.select("doc_id", F.explode(hosts).alias("tile"))
    links = cm.materialise(_meet(docs, one.unionByName(pivots), n, pct))

    if large.limit(1).count():
        links = _remaining_tile_pairs(docs, large, links, n, pct, named)

    return links


def _remaining_tile_pairs(docs: DataFrame, large: DataFrame, links: DataFrame, n: int, pct: int, named) -> DataFrame:
    """Links of the tile pairs that the pivot round has not made one component; compared pair by pair of tiles."""
    found = cm.components(links)
    at = large.join(found, large.doc_id == found.node, "left").select("doc_id", "block", "band", "cut", F.coalesce("label", "doc_id").alias("label"))
    tiles = cm.materialise(at.groupBy("block", "band", "cut").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
    x, y = tiles.alias("x"), tiles.alias("y")
    same_block = (F.col("x.block") == F.col("y.block")) & ((F.col("x.band") == F.col("y.band")) & (F.col("x.cut") < F.col("y.cut")) & (F.col("x.cut") > 0) | (F.col("y.band") == F.col("x.band") + 1) & ((F.col("x.cut") > 0) | (F.col("y.cut") > 0)))
    apart = ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))
    pairs = x.join(y, same_block & apart).select(F.col("x.block").alias("block"), F.col("x.band").alias("band_x"), F.col("x.cut").alias("cut_x"), F.col("y.band").alias("band_y"), F.col("y.cut").alias("cut_y"))
    pairs = pairs.withColumn("tile", named(F.col("block"), F.col("band_x"), F.col("cut_x"), F.col("band_y"), F.col("cut_y")))
    ends = pairs.select("tile", "block", F.explode(F.array(F.struct(F.col("band_x").alias("band"), F.col("cut_x").alias("cut")), F.struct(F.col("band_y").alias("band"), F.col("cut_y").alias("cut")))).alias("e"))
    ends = cm.materialise(ends.select("tile", "block", "e.band", "e.cut"))
    places = ends.join(large, ["block", "band", "cut"]).select("doc_id", "tile")
    return cm.materialise(links.unionByName(_meet(docs, places, n, pct)))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, that of its smallest doc_id; rows without doc_id all stay."""
    groups = cm.materialise(ngram_jaccard(docs, **options))
    again = groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__gone"))
    gone = cm.materialise(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), F.lit(False).alias("__again")).distinct().unionByName(again.withColumn("__again", F.lit(True))))
    mask = cm.member_mask(gone.select("__gone"))
    looked_at = cm.masked(docs, mask, "doc_id")
    flags = gone.groupBy("__gone").agg(F.max("__again").alias("__again"), F.min("__again").alias("__only_again"))
    joined = looked_at.join(flags, looked_at["doc_id"] == flags["__gone"], "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stay = joined.filter("__gone is null").select(*columns)
    # Rows that share a doc_id are one document: one of them stays, if their document does.
    twice = joined.filter("__only_again").dropDuplicates(["doc_id"]).select(*columns)
    return cm.masked(docs, mask, "doc_id", inside=False).unionByName(stay).unionByName(twice)


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard(cm.read_table(spark, sf_dir, "documents"), n=4, pct=85)
