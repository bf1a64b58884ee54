"""What the training-data operators share: reading rows as Arrow chunks, hashing
byte spans in bulk, sketches of fixed size, and connected components."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.session import durable

CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3


def row_key(*columns: str) -> Column:
    """One number per row content; repeated rows share it, and nothing depends on
    ids being unique."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def fresh(taken: list[str], name: str) -> str:
    """A column name that is not taken, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


# --- Arrow batches -------------------------------------------------------------

def chunks(batches, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches holding about `limit` bytes of text each, so
    that working memory follows the longest text and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets_of(batch.column(column)))
        at, room = 0, 0
        for i, size in enumerate(sizes):
            if i > at and room + size > limit:
                yield batch.slice(at, i - at)
                at, room = i, 0
            room += size
        yield batch.slice(at)


def offsets_of(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    raw = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return raw.astype(np.int64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each begins; null texts
    are empty."""
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    at = offsets_of(column)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


# --- hashing -------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 2)
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers[:] = made
    return _powers[0], _powers[1]


class Spans:
    """Hashes of any byte ranges of an array, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.up, down = _powers_to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * down[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start])

    def rolling(self, width: int) -> np.ndarray:
        """The hash of every range of `width` bytes."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.up[:n])


# --- sketches of a fixed size --------------------------------------------------

SLICE = 4096


SLICES = "place int, counts binary"


def slices(counts: np.ndarray) -> pa.RecordBatch:
    """An array as its packed slices, empty ones left out."""
    table = np.append(counts, np.zeros(-len(counts) % SLICE, counts.dtype)).reshape(-1, SLICE)
    full = np.flatnonzero(table.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([zlib.compress(table[i].tobytes(), 1) for i in full], pa.binary())],
        ["place", "counts"])


def merged(parts: DataFrame, slots: int, kind, join: Callable = np.add, tasks: int = 16) -> np.ndarray:
    """Combine the slices that tasks emit into one array of `slots` numbers.  They
    are combined as they stream past, and the result's size is fixed by `slots`,
    whatever the input."""

    def total(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(raw), kind)
                held[place] = join(held[place], got) if place in held else got
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())],
            ["place", "counts"])

    rows = parts.repartition(tasks, "place").mapInArrow(total, SLICES).collect()
    out = np.zeros(slots + -slots % SLICE, kind)
    for place, raw in rows:
        out[place * SLICE : (place + 1) * SLICE] = np.frombuffer(zlib.decompress(raw), kind)
    return out[:slots]


def marks(column: DataFrame, slots: int) -> np.ndarray:
    """A table of `slots` marks, set where some number of the one-column frame falls.
    A filter without misses whose size is fixed; false passes are the caller's to
    sort out."""

    def note(batches):
        seen = np.zeros(slots, np.uint8)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            seen[slot_of(values.view(np.uint64), slots)] = 1
        yield slices(np.packbits(seen))

    packed = merged(column.mapInArrow(note, SLICES), slots // 8, np.uint8, np.bitwise_or)
    return np.unpackbits(packed).astype(bool)


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)


# --- connected components ------------------------------------------------------

def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """(node, component) of the edges (a, b): the smallest node that is reachable, for
    every node but those that are the smallest themselves.

    Alternates two steps until nothing changes: every node sends its larger
    neighbours to the smallest one around it, then every node sends its smaller
    neighbours and itself there.  Both need only a minimum per node, which is
    combined before the shuffle, so a node with millions of neighbours is no large
    group.  Each round is written to the shared checkpoint folder."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = keep(edges)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        edges = keep(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component"))
