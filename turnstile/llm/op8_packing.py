"""Best-fit packing under conflicts.

Documents are laid into bins of a fixed number of words.  A document longer than a bin is cut: its full pieces are bins
of their own, its rest is packed.  Rests go longest first, each into the tightest bin it fits: bins stand ordered by
what they have left, and from the first with enough room the search goes on to the next until one is compatible.  A bin
carries bitmaps: for each source, PER_SOURCE planes (a full last plane: no further document of it), and for each
duplicate cluster a bit (no two members together).

Packing runs in shards of about SHARD documents by hash of doc_id, so sources and clusters of any size are spread
evenly and a task holds one shard.  Bits are numbered inside the shard, exactly.

Defined results: a document without words goes in no bin (piece 0, n_tokens 0, null bin).  Null sources count as one
source.  Null doc_ids are packed like others.  Repeated rows are packed as often as they come, in different bins, as
they are one cluster.  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm import common as cm

CAPACITY = 2048
PER_SOURCE = 2
SHARD = 2048


class Packer:
    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (room left, bin), ascending
        self.planes: list[list[int]] = []
        self.clusters: list[int] = []

    def add(self, size: int, source: int, cluster: int) -> int:
        """The bin of a rest of size words; source and cluster are single bits (cluster 0: in no cluster)."""
        at = bisect_left(self.order, (size, -1))
        last = self.per_source - 1
        while at < len(self.order):
            room, b = self.order[at]
            if not (self.planes[b][last] & source) and not (self.clusters[b] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            room, b = self.capacity, len(self.planes)
            self.planes.append([0] * self.per_source)
            self.clusters.append(0)
        for k, plane in enumerate(self.planes[b]):
            if not plane & source:
                self.planes[b][k] |= source
                break
        self.clusters[b] |= cluster
        if room > size:
            insort(self.order, (room - size, b))
        return b


_OUT = "doc_id long, piece int, start long, n_tokens long, bin long"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def _pack_shard(rows: list[tuple], shard: int, capacity: int, per_source: int):
    """rows: (doc_id, source, cluster, n), longest rest first."""
    base, full, packer = shard << 32, 0, Packer(capacity, per_source)
    sizes: dict = {}
    for _, _, c, _ in rows:
        sizes[c] = sizes.get(c, 0) + 1
    bits: dict = {}
    for c, k in sizes.items():
        if k > 1:
            bits[c] = 1 << len(bits)
    sources: dict = {}
    out, rests = [], []
    for doc_id, source, cluster, n in rows:
        pieces = n // capacity
        for p in range(pieces):
            out.append((doc_id, p, p * capacity, capacity, base | (1 << 31) | full))
            full += 1
        rest = n - pieces * capacity
        if rest:
            rests.append((doc_id, pieces, pieces * capacity, rest, source, cluster))
        elif not n:
            out.append((doc_id, 0, 0, 0, None))
    rests.sort(key=lambda x: -x[3])
    for doc_id, p, start, rest, source, cluster in rests:
        b = packer.add(rest, sources.setdefault(source, 1 << len(sources)), bits.get(cluster, 0))
        out.append((doc_id, p, start, rest, base | b))
    return out


def _packs(capacity: int, per_source: int):
    def run(batches):
        now, rows = None, []

        def flush():
            out = _pack_shard(rows, now, capacity, per_source)
            return cm.record_batch([c.split()[0] for c in _OUT.split(", ")], list(zip(*out, strict=True)), _TYPES)

        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("shard", "doc_id", "source", "cluster", "n")), strict=True):
                if row[0] != now:
                    if rows:
                        yield flush()
                    now, rows = row[0], []
                rows.append(row[1:])
        if rows:
            yield flush()

    return cm.tidy(run)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``: places where a word follows white space, counted without an array."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin): words start .. start + n_tokens of the document stand in the bin.

    A docs column dup_cluster (long) names duplicate clusters; without it, equal texts are one cluster.
    """
    cluster = F.col("dup_cluster").cast("long") if "dup_cluster" in docs.columns else F.xxhash64(F.coalesce("text", F.lit("")))
    kept = [c for c in ("doc_id", "source", "text") if c in docs.columns]
    rows = cm.with_columns(docs.select(*kept, cluster.alias("cluster")), doc_id="long", source="string", text="string", cluster="long")
    sized = cm.materialise(rows.select("doc_id", "source", "cluster", word_count(F.col("text")).alias("n")))
    shards = max(1, -(-sized.count() // shard_rows))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))
    return dealt.repartition("shard").sortWithinPartitions("shard", F.col("n").desc(), "doc_id", "source", "cluster").mapInArrow(_packs(capacity, per_source), _OUT)


def bins(pieces: DataFrame) -> DataFrame:
    """(bin, n_tokens, doc_ids, starts, lengths) of each bin; a bin holds CAPACITY words at most."""
    inside = pieces.filter("bin is not null").groupBy("bin").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("doc_id", "start", "n_tokens"))).alias("p"))
    return inside.select("bin", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.n_tokens").alias("lengths"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(cm.read_table(spark, sf_dir, "documents"))
