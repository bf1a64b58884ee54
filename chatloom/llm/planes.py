"""Clustering around centroids by bit planes.

Every component x becomes the integer floor(scale * x).  Plane i of a vector holds bit i
of 64 components in one unsigned 64-bit number (two's complement, the top plane counts
negative), so a vector of 64 components with small values is a dozen numbers.  A dot
product is the sum over all pairs of planes of popcount(AND) times both planes' weights:
exact, without multiplying components.  Squared distances follow from three dot products,
|x|^2 - 2 x.c + |c|^2; |x|^2 is computed once.

The planes are packed once and written to the shared checkpoint folder.  A round is one
job over them: each task assigns its rows and sums its members' planes, so only
clusters * width sums leave a task; they are added up exactly in Spark.  The centroids,
whose number and width are parameters, travel with the task.

Nulls and edges: only vectors of the given width whose components are all there and finite
take part; other rows are left out.  An empty table gives no rows, fewer vectors than
clusters give fewer clusters.  Repeated rows are separate vectors; where they share the
hash that picks the first centroids, the order of their planes decides, and equal vectors
may be two centroids, of which the second stays empty.  A null id counts as empty text in that hash.  A vector with an integer
beyond 27 bits, whose squared distance may fit no long, joins no cluster and has nulls in
their place.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import durable

#: Integers outside [-FIT, FIT) join no cluster; rows compared with all centroids at a time.
FIT, ROWS = 1 << 27, 4096
LONGEST = (1 << 63) - 1


def bits_of(values: np.ndarray) -> int:
    """Planes that hold all values in two's complement."""
    if not values.size:
        return 1
    return max(int(values.max()), -int(values.min()) - 1).bit_length() + 1


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, planes, words) of an integer matrix; each word holds one bit of 64 components."""
    n, width = values.shape
    words = -(-width // 64)
    whole = np.zeros((n, words * 64), np.int64)
    whole[:, :width] = values
    out = np.empty((n, bits, words), np.uint64)
    for i in range(bits):
        out[:, i] = np.packbits((whole >> i & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
    return out


def weights(bits: int) -> np.ndarray:
    """What a bit of each plane counts."""
    out = np.int64(1) << np.arange(bits, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products of every row of planes `x` with every row of planes `c`."""
    out = np.zeros((len(x), len(c)), np.int64)
    right = weights(c.shape[1])
    for i, left in enumerate(weights(x.shape[1])):
        both = np.bitwise_count(x[:, i, None, None, :] & c[None])
        counts = both[..., 0] if both.shape[-1] == 1 else both.sum(axis=-1, dtype=np.int64)
        out += left * (counts.astype(np.int64) * right).sum(axis=-1)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """Exact dot product of every row of planes with itself."""
    scale = weights(x.shape[1])
    out = np.zeros(len(x), np.int64)
    for i, left in enumerate(scale):
        counts = np.bitwise_count(x[:, i, None] & x).sum(axis=-1, dtype=np.int64)
        out += left * (counts * scale).sum(axis=-1)
    return out


def totals(x: np.ndarray, width: int) -> np.ndarray:
    """Sum of the vectors, component by component, from the number of ones in each plane."""
    ones = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=-1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (weights(x.shape[1])[:, None] * ones).sum(axis=0)[:width]


class Centroids:
    """Integer centroids with their planes; travels to the tasks."""

    def __init__(self, rows: list[list[int]], width: int):
        self.rows, self.width = rows, width
        values = np.array(rows, np.int64).reshape(len(rows), width)
        self.planes = pack(values, bits_of(values))
        self.norms = (values * values).sum(axis=1)

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid, the smaller of equals, and the squared distance."""
        best, far = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
        for at in range(0, len(x), ROWS):
            part = slice(at, at + ROWS)
            apart = norms[part, None] - 2 * dots(x[part], self.planes) + self.norms[None]
            best[part] = apart.argmin(axis=1)
            far[part] = apart.min(axis=1)
        return best, far

    def digest(self, number: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[number])).encode()).hexdigest()


def groups(batch: pa.RecordBatch, width: int):
    """(rows, planes, norms) of the rows of a batch that share a number of planes."""
    raws, norms = batch.column("planes"), batch.column("norm").to_numpy(zero_copy_only=False)
    sizes = np.array([-1 if s is None else s for s in pa.compute.binary_length(raws).to_pylist()], np.int64)
    words = -(-width // 64)
    for size in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        joined = b"".join(raws.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(joined, "<u8").reshape(len(rows), -1, words), norms[rows].astype(np.int64)


def packed(df: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """The rows that take part, as planes with their squared length."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = df.where(F.col(vector).isNotNull()).where((F.size(vector) == width) & fine)
    some = some.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))

    def work(batches):
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            with np.errstate(over="ignore"):
                whole = np.floor(flat * scale)
            held = ((whole >= -FIT) & (whole < FIT)).all(axis=1)
            values = np.where(held[:, None], whole, 0).astype(np.int64)
            x = pack(values, bits_of(values))
            # Planes that only repeat the sign are left out, so equal vectors have equal bytes.
            low = np.maximum(values, -values - 1).max(axis=1, initial=0)
            used = np.frexp(low.astype(np.float64))[1] + 1
            raws = [row[:n].tobytes() if ok else None for row, n, ok in zip(x, used.tolist(), held.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(raws, pa.binary()), pa.array(squares(x), pa.int64())], ["key", "planes", "norm"])

    kind = df.schema[key].dataType.simpleString()
    return some.mapInArrow(work, f"key {kind}, planes binary, norm long")


def decode(raw: bytes, width: int) -> list[int]:
    """The integers of one row of planes."""
    x = np.frombuffer(raw, "<u8").reshape(1, -1, -(-width // 64))
    return totals(x, width).tolist()


def first_centroids(rows: DataFrame, clusters: int, seed: int, width: int) -> list[list[int]]:
    """The vectors whose hashed ids come first."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    chosen = (
        rows.where("planes is not null").select(F.sha2(name, 256).alias("place"), "planes")
        .orderBy("place", "planes").limit(clusters).collect()
    )
    return [decode(r["planes"], width) for r in chosen]


def moved(rows: DataFrame, centres: Centroids) -> Centroids:
    """One round: every centroid with members goes to the floor of their mean."""
    k, width = len(centres.rows), centres.width

    def work(batches):
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, norms in groups(batch, width):
                best, _ = centres.nearest(x, norms)
                for c in np.unique(best).tolist():
                    sums[c] += totals(x[best == c], width)
                counts += np.bincount(best, minlength=k)
        used = np.flatnonzero(counts)
        # One row per component, the count as component -1.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width + 1), pa.int32()), pa.array(np.tile(np.arange(-1, width), len(used)), pa.int32()),
             pa.array(np.column_stack((counts[used], sums[used])).ravel(), pa.int64())], ["cluster", "place", "total"])

    parts = rows.mapInArrow(work, "cluster int, place int, total long")
    added = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {(r["cluster"], r["place"]): int(r["total"]) for r in added}
    return Centroids(
        [[found[c, i] // found[c, -1] for i in range(width)] if (c, -1) in found else old for c, old in enumerate(centres.rows)], width)


def fit(rows: DataFrame, clusters: int, rounds: int, seed: int, width: int) -> Centroids | None:
    start = first_centroids(rows, clusters, seed, width)
    if not start:
        return None
    centres = Centroids(start, width)
    for _ in range(rounds):
        centres = moved(rows, centres)
    return centres


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = 8, rounds: int = 10,
            seed: int = 3, scale: int = 1024, width: int = 64) -> DataFrame:
    """Per vector: its cluster, the squared distance, that summed over the cluster and over
    all, and the digest of the cluster's centroid.  Sums beyond a long are null."""
    rows = durable(packed(df, key, vector, width, scale))
    centres = fit(rows, clusters, rounds, seed, width)
    assigned = rows.mapInArrow(_assign(centres, width), f"key {rows.schema['key'].dataType.simpleString()}, cluster int, distance long")
    inertia = dict(assigned.where("cluster is not null").groupBy("cluster")
                   .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect())
    whole = sum(inertia.values())

    def pick(values: dict, kind: str) -> Column:
        out = F.lit(None)
        for c, value in values.items():
            out = F.when(F.col("cluster") == c, F.lit(value)).otherwise(out)
        return out.cast(kind)

    held = lambda x: int(x) if x <= LONGEST else None
    return assigned.select(
        F.col("key").alias(key), "cluster", "distance", pick({c: held(x) for c, x in inertia.items()}, "long").alias("cluster_inertia"),
        F.lit(held(whole)).cast("long").alias("inertia"),
        pick({c: centres.digest(c) for c in inertia}, "string").alias("centroid_sha256"))


def _assign(centres: Centroids | None, width: int):
    def work(batches):
        for batch in batches:
            n = batch.num_rows
            best, far, there = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
            if centres is not None:
                for at, x, norms in groups(batch, width):
                    best[at], far[at] = centres.nearest(x, norms)
                    there[at] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(best, pa.int32(), mask=~there), pa.array(far, pa.int64(), mask=~there)],
                ["key", "cluster", "distance"])

    return work
