"""Shared plumbing: tables in the shared folder, bounded histograms, columns, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import textvec as tv


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="turnstile-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset a folder of our own on a local master, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_own_folder()}"


class Tables:
    """The tables that materialise() makes while this scope is the innermost open one.

    drop() deletes these and no others, so frames made elsewhere in the process, by another run say, stay readable.
    Tables made outside any scope stay until discard() or the folder's owner removes them.
    """

    _open: ClassVar[list[Tables]] = []

    def __init__(self) -> None:
        self.paths: set[str] = set()

    def __enter__(self) -> Tables:
        Tables._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Tables._open.remove(self)

    def drop(self, spark: SparkSession) -> None:
        while self.paths:
            _delete(spark, self.paths.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor repeats no work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if Tables._open:
        Tables._open[-1].paths.add(path)
    out.turnstile_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialise() made and that nothing unwritten reads any more."""
    for df in frames:
        path = getattr(df, "turnstile_path", None)
        if path:
            for scope in Tables._open:
                scope.paths.discard(path)
            _delete(df.sparkSession, path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, handing what it freed back to the system at its end: Spark keeps idle Python workers for a minute."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError, TypeError):
                # glibc alone has it; elsewhere the allocator decides.
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


#: Bits of a membership mask: 64 a key at least, between 64 KB and 16 MB.
MASK_BITS = (19, 27)


def _mask_bits(columns: list[pa.Array], size: int) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = tv.mix(h ^ pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    return (h >> np.uint64(64 - size)).astype(np.int64)


def member_mask(keys: DataFrame) -> bytes:
    """A mask that holds every row of keys (long or int columns), and now and then another key.

    It only lets rows skip a shuffle; an exact join decides on those it lets through.  Its size follows the number of
    keys up to 16 MB (134 million bits); beyond some million keys it lets more and more through, never less.  Each
    task sends its own bits; they are united by slice before they reach the driver.
    """
    names = keys.columns
    size = min(MASK_BITS[1], max(MASK_BITS[0], (64 * keys.count()).bit_length()))

    def own(batches):
        bits = np.zeros((1 << size) // 8, dtype=np.uint8)
        for b in batches:
            at = _mask_bits([b[n] for n in names], size)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        parts = np.split(bits, HIST_SLICES)
        some = [k for k, x in enumerate(parts) if x.any()]
        yield record_batch(["slice", "bits"], [some, [zlib.compress(parts[k].tobytes(), 1) for k in some]], [pa.int32(), pa.binary()])

    def unite(batches):
        united: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b["slice"].to_pylist(), b["bits"], strict=True):
                part = np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.uint8)
                united[k] = united[k] | part if k in united else part
        yield record_batch(["slice", "bits"], [list(united), [zlib.compress(x.tobytes(), 1) for x in united.values()]], [pa.int32(), pa.binary()])

    out = np.zeros((1 << size) // 8, dtype=np.uint8)
    width = len(out) // HIST_SLICES
    schema = "slice int, bits binary"
    for k, blob in keys.mapInArrow(tidy(own), schema).repartition(HIST_SLICES, "slice").mapInArrow(tidy(unite), schema).collect():
        out[k * width : (k + 1) * width] = np.frombuffer(zlib.decompress(bytes(blob)), dtype=np.uint8)
    return zlib.compress(out.tobytes(), 1)


def open_mask(mask: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(mask), dtype=np.uint8)


def in_mask(bits: np.ndarray, columns: list[pa.Array]) -> np.ndarray:
    at = _mask_bits(columns, (8 * len(bits)).bit_length() - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).view(bool)


def masked(df: DataFrame, mask: bytes, key: str, inside: bool = True) -> DataFrame:
    """Rows whose long key the mask holds, or the others; rows without key count as others."""

    def run(batches):
        bits = open_mask(mask)
        for b in batches:
            ids = b[key].cast(pa.int64())
            hit = in_mask(bits, [ids]) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(hit if inside else ~hit))

    return df.mapInArrow(tidy(run), df.schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """Just the named columns, cast; a column that the input lacks is null."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def record_batch(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


#: Hash buckets of the rarity histogram: 2**20 counters of 4 bytes in a task, a byte each where it is sent out.
HIST_BITS = 20
HIST_SLICES = 16


def bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; buckets is a power of two."""
    return (hashes >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def hist_rows(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A task's histogram as HIST_SLICES compressed slices."""
    parts = np.split(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32), HIST_SLICES)
    some = [k for k, x in enumerate(parts) if x.any()]
    return some, [zlib.compress(parts[k].tobytes(), 1) for k in some]


def levels(hist: np.ndarray) -> np.ndarray:
    """Counts on a scale of 256 levels, finest where they are small: all that the order of rarity needs."""
    out = np.minimum(hist, 15).astype(np.float64)
    large = hist > 15
    out[large] = np.minimum(15 + 8 * np.log2(hist[large] / 15.0), 255)
    return out.astype(np.uint8)


def merge_hist(slices: DataFrame, bits: int = HIST_BITS) -> np.ndarray:
    """Levels of the sum of the tasks' (slice, counts) rows; HIST_SLICES rows of fixed size reach the driver."""

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b["slice"].to_pylist(), b["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.uint32).astype(np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield record_batch(["slice", "counts"], [list(sums), [zlib.compress(levels(x).tobytes(), 1) for x in sums.values()]], [pa.int32(), pa.binary()])

    out = np.zeros(1 << bits, dtype=np.uint8)
    width = len(out) // HIST_SLICES
    merged = slices.repartition(HIST_SLICES, "slice").mapInArrow(tidy(merge), "slice int, counts binary")
    for k, blob in merged.collect():
        out[k * width : (k + 1) * width] = np.frombuffer(zlib.decompress(bytes(blob)), dtype=np.uint8)
    return out


def rank_by_rarity(hist: np.ndarray, uniq: np.ndarray) -> np.ndarray:
    """Places of sorted distinct hashes in the one global order (bucket level, hash)."""
    order = np.argsort(hist[bucket(uniq, len(hist))], kind="stable")
    out = np.empty(len(uniq), dtype=np.int64)
    out[order] = np.arange(len(uniq))
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) long edges: (node, label), the label being the smallest node.

    Smallest-label propagation with pointer jumping; each round is two joins of tables in the shared folder, so a
    hub's rows are split by the skew join, and counts of changes alone reach the driver.  Stars and short chains
    end in a few rounds, a chain of n nodes in about log n.
    """
    both = materialise(edges.select("a", "b").filter("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        heard = both.join(labels.select("node", "label"), both.a == F.col("node")).select(F.col("b").alias("node"), "label")
        new = materialise(labels.select("node", "label", F.col("label").alias("old")).unionByName(heard.withColumn("old", F.lit(None).cast("long"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        up = new.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = materialise(new.join(up, new.label == up.up, "left").select("node", F.coalesce(F.least("label", "up_label"), "label").alias("label"), "old"))
        changed = jumped.filter("label <> old").limit(1).count()
        discard(new, labels)
        labels = jumped
        if not changed:
            discard(both)
            return jumped.select("node", "label")


def union_find(n: int) -> tuple[Callable[[int], int], Callable[[int, int], bool]]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(x: int, y: int) -> bool:
        x, y = find(x), find(y)
        if x == y:
            return False
        parent[max(x, y)] = min(x, y)
        return True

    return find, union


def words_of_chunk(chunk: tv.Chunk, lower: bool = True):
    return tv.words(chunk, tv.SPACED, lower)
