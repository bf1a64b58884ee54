"""Packing whole pieces into few sequences by vector best fit.

A sequence has three capacities: tokens, pieces, and attention cost, the sum of the squared
piece lengths that a mask by document leaves to compute.  Texts longer than the longest
piece are cut, others stay whole.  Pieces go from the longest to the shortest; each goes to
the open sequence in which it fits best under all three capacities, or opens one.  What is
best is either the largest weighted dot product of the piece's needs with what is taken
already (`dot`), or the smallest weighted norm of what stays free (`norm`); all in shares
of the capacities.

Encoding gives one short row per piece, written to the shared checkpoint folder.  The rows
are dealt into pools of about `POOL` by a hash, a pool is packed in one task, so its size
is bounded whatever the table, and few sequences of a pool stay unfilled.  A pool's rows
are ordered before they are packed: a retried task gives the same sequences.  Equal lengths
are placed together: as many open sequences as there are such pieces take one each, the
best first, until none has room.

Nulls and edges: a null text counts as empty, which still is one closing id.  Null ids and
repeated rows are packed like any other row.  An empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.packing import ID_BYTES
from chatloom.llm.wordids import WordIds
from chatloom.session import durable

#: Pieces packed together; texts encoded at a time.
POOL, TEXTS = 50_000, 256


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    pieces: int = 512
    attention: int = 2048 * 2048

    @property
    def longest(self) -> int:
        """The longest piece that an empty sequence takes."""
        return min(self.tokens, math.isqrt(self.attention))

    def needs(self, length: int) -> np.ndarray:
        """A piece's needs in shares of the capacities."""
        return np.array([length, 1, length * length], np.int64) / self.whole

    @property
    def whole(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces, self.attention], np.int64)


@dataclass(frozen=True)
class Rule:
    """How an open sequence is chosen: by `dot` product or residual `norm`, with weights
    for tokens, pieces and attention cost."""

    kind: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)

    def score(self, free: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Smaller is better; `free` and `need` in shares of the capacities."""
        w = np.array(self.weights)
        if self.kind == "dot":
            return -(1 - free) @ (w * need)
        left = free - need
        return (w * left * left).sum(axis=1)


def place(lengths: np.ndarray, capacity: Capacity | None = None, rule: Rule | None = None) -> np.ndarray:
    """The sequence of each piece; the lengths must not increase."""
    capacity, rule = capacity or Capacity(), rule or Rule()
    whole = capacity.whole
    if not len(lengths):
        return np.zeros(0, np.int64)
    least = np.array([lengths[-1], 1, lengths[-1] ** 2], np.int64)
    out = np.zeros(len(lengths), np.int64)
    room = np.zeros((len(lengths), 3), np.int64)
    opened = 0
    live = np.zeros(0, np.int64)  # open sequences that could still take something
    starts = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1]))
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(lengths)], strict=True):
        size = int(lengths[at])
        need, share = np.array([size, 1, size * size], np.int64), capacity.needs(size)
        while at < end:
            fit = live[(room[live] >= need).all(axis=1)]
            if not len(fit):
                # New sequences take as many of the rest as fit into them, one after another.
                each = int((whole // need).min())
                count = -(-(end - at) // each)
                fresh = np.arange(opened, opened + count)
                out[at:end] = np.repeat(fresh, each)[: end - at]
                used = np.bincount(out[at:end] - opened, minlength=count)
                room[fresh] = whole - used[:, None] * need
                opened += count
                live = np.concatenate((live, fresh))
                break
            score = rule.score(room[fit] / whole, share)
            # The best first; of equals the one opened first.
            chosen = fit[np.argsort(score, kind="stable")[: end - at]]
            out[at : at + len(chosen)] = chosen
            room[chosen] -= need
            at += len(chosen)
        # The last piece is the shortest: what cannot take it is done.
        live = live[(room[live] >= least).all(axis=1)]
    return out


_words: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, close_id: int, longest: int, key: str, text: str) -> DataFrame:
    """One row per piece, with a number of its own that a retried task gives again."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        if path not in _words:
            _words[path] = WordIds(path)
        words, close = _words[path], np.array([close_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                out = []
                for name, ids in zip(part.column(key).to_pylist(), words.ids([t or "" for t in part.column(text).to_pylist()]), strict=True):
                    ids += close
                    size = len(ids) // ID_BYTES
                    for i, start in enumerate(range(0, size, longest)):
                        length = min(longest, size - start)
                        crc = zlib.crc32(memoryview(ids)[start * ID_BYTES : (start + length) * ID_BYTES])
                        out.append((name, i, start, length, crc, number))
                        number += 1
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], part.schema.field(key).type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                    ["key", "piece", "start", "length", "ids_crc32", "number"])

    return docs.select(key, text).mapInArrow(work, f"key {kind}, piece int, start long, length long, ids_crc32 long, number long")


def pack(docs: DataFrame, path: str, close_id: int = 0, capacity: Capacity | None = None, rule: Rule | None = None,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    capacity = capacity or Capacity()
    rows = durable(pieces(docs, path, close_id, capacity.longest, key, text))
    pools = max(1, -(-rows.count() // POOL))

    def work(pool: pa.Table) -> pa.Table:
        pool = pool.sort_by([("length", "descending"), ("number", "ascending")])
        lengths = pool.column("length").to_numpy()
        sequence = place(lengths, capacity, rule)
        order = np.argsort(sequence, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.append(True, np.diff(sequence[order]) > 0)
        begin = ends - lengths[order]
        offset = begin - begin[first][np.cumsum(first) - 1]
        pool = pool.take(pa.array(order))
        number = (pool.column("pool").to_numpy() << 32) + sequence[order]
        columns = [pool.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")]
        return pa.table([*columns, pa.array(number, pa.int64()), pa.array(offset, pa.int64())], names=names)

    names = ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    pooled = rows.withColumn("pool", F.pmod(F.xxhash64("number"), F.lit(pools)))
    return pooled.groupBy("pool").applyInArrow(work, schema).withColumnRenamed("key", key)
