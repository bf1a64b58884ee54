"""Packing token sequences under several limits at once.

A sequence holds at most so many tokens, so many segments, and so many tokens that
bear loss.  Each example, or what is left of it after whole sequences are cut off,
goes to the open sequence whose free room points most in the direction of the
example's needs: the largest dot product of the two vectors, each in shares of the
limits.  A bounded pool of sequences is open at a time; when it overflows, the
fullest one is topped up with the head of the example and closed.  At a task's end
the rests are joined, and the last partial sequence is cut into powers of two, so
hardly any padding is left.

Every task packs the rows it reads, streaming: no shuffle, no group, and a retried
task gives the same sequences.  Sequence numbers carry the task's number.

Nulls and edges: a null text counts as empty, which still is one closing id.  Null
ids and repeated rows are packed like any other row.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from chatloom.llm.wordids import ID_BYTES, WordIds

#: Open sequences per task; texts encoded at a time.
OPEN, TEXTS = 64, 128


@dataclass
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass
class Example:
    """One document's ids; those from `loss_from` on bear loss."""

    key: object
    ids: bytes
    loss_from: int = 1

    @property
    def size(self) -> int:
        return len(self.ids) // ID_BYTES

    def loss(self, start: int, end: int) -> int:
        return max(0, end - max(start, self.loss_from))

    def reach(self, start: int, end: int, loss: int) -> int:
        """The furthest end up to which at most `loss` loss-bearing ids lie."""
        return min(end, max(start, self.loss_from) + loss)


Piece = tuple[Example, int, int]


@dataclass
class Packer:
    limits: Limits = field(default_factory=Limits)
    open_most: int = OPEN

    def __post_init__(self):
        x = self.limits
        self.whole = np.array([x.tokens, x.segments, x.loss], float)
        self.room = np.zeros((self.open_most + 1, 3))
        self.bins: list[list[Piece]] = []

    def add(self, example: Example) -> Iterator[list[Piece]]:
        """Place one example; yields the sequences that this closes."""
        start, size, x = 0, example.size, self.limits
        while size - start >= x.tokens or example.loss(start, size) > x.loss:
            end = example.reach(start, min(size, start + x.tokens), x.loss)
            yield [(example, start, end)]
            start = end
        while start < size:
            need = np.array([size - start, 1, example.loss(start, size)], float)
            room = self.room[: len(self.bins)]
            fit = np.flatnonzero((room >= need).all(axis=1))
            if len(fit):
                # The direction of the free room against the needs, both in shares of the limits.
                at = int(fit[np.argmax((room[fit] / self.whole) @ (need / self.whole))])
                yield from self._put(at, (example, start, size), need)
                return
            if len(self.bins) < self.open_most:
                self.bins.append([])
                self.room[len(self.bins) - 1] = self.whole
                continue
            at = int(np.argmin(room[:, 0]))
            free = room[at]
            end = example.reach(start, min(size, start + int(free[0])), int(free[2])) if free[1] >= 1 else start
            if end > start:
                self.bins[at].append((example, start, end))
                start = end
            yield self._close(at)

    def _put(self, at: int, piece: Piece, need: np.ndarray) -> Iterator[list[Piece]]:
        self.bins[at].append(piece)
        self.room[at] -= need
        if self.room[at, 0] == 0:
            yield self._close(at)

    def _close(self, at: int) -> list[Piece]:
        done, last = self.bins[at], len(self.bins) - 1
        self.bins[at], self.room[at] = self.bins[last], self.room[last]
        self.bins.pop()
        return done

    def rest(self) -> Iterator[list[Piece]]:
        """Join what is open, and cut the last part into powers of two."""
        x = self.limits
        now: list[Piece] = []
        tokens = loss = 0
        for example, start, size in [p for b in self.bins for p in b]:
            while start < size:
                end = example.reach(start, min(size, start + x.tokens - tokens), x.loss - loss)
                if end == start or len(now) == x.segments:
                    yield now
                    now, tokens, loss = [], 0, 0
                    continue
                now.append((example, start, end))
                tokens += end - start
                loss += example.loss(start, end)
                start = end
        self.bins = []
        while now:
            tokens = sum(end - start for _, start, end in now)
            take = 1 << (tokens.bit_length() - 1)
            part, later = [], []
            for example, start, end in now:
                cut = min(end, start + take)
                if cut > start:
                    part.append((example, start, cut))
                    take -= cut - start
                if cut < end:
                    later.append((example, cut, end))
            yield part
            now = later


class Words(WordIds):
    """The ids, as bytes, of texts."""

    @property
    def tokenizer(self):
        return self.library


_words: dict[str, Words] = {}

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, close_id: int = 2, key: str = "doc_id", text: str = "text",
         limits: Limits | None = None, loss_from: Callable[[str], int] | None = None) -> DataFrame:
    """One row per piece.  `loss_from` says how many leading ids of a text bear no
    loss; without it that is the first one, which nothing predicts."""
    limits = limits or Limits()
    names = [key, *(p.split()[0] for p in PIECES.split(", "))]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {PIECES}"

    def work(batches):
        if path not in _words:
            _words[path] = Words(path)
        words, packer = _words[path], Packer(limits)
        close = np.array([close_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 36
        arrow = None

        def table(done: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out = []
            for sequence in done:
                offset = 0
                for example, start, end in sequence:
                    crc = zlib.crc32(memoryview(example.ids)[start * ID_BYTES : end * ID_BYTES])
                    out.append((example.key, start, end - start, crc, example.size, number, offset))
                    offset += end - start
                number += 1
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            arrow = batch.schema.field(key).type
            for at in range(0, batch.num_rows, TEXTS):
                part, done = batch.slice(at, TEXTS), []
                texts = [value or "" for value in part.column(text).to_pylist()]
                for name, value, ids in zip(part.column(key).to_pylist(), texts, words.ids(texts), strict=True):
                    done += packer.add(Example(name, ids + close, 1 if loss_from is None else loss_from(value)))
                yield table(done)
        if arrow is not None:
            yield table(list(packer.rest()))

    return docs.select(key, text).mapInArrow(work, schema)
