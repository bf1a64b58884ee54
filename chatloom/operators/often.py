"""Which of very many numbers occur often, from packed lists of them.

Numbers below a power of two are sorted and written as in Elias and Fano: the lower bits as
they are, the upper ones as steps.  A list costs two to three bits a number more than its
numbers' mean distance has, far less than a row for each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import durable

# Numbers that a task sorts at a time, and about as many meet in one group.
CHUNK = 1 << 22
LIST = "at int, n long, low int, body binary"


def packed(numbers: np.ndarray, bits: int) -> tuple[int, bytes]:
    """Ascending numbers below 2 ** bits: how many lower bits stand as they are, and the list."""
    n = len(numbers)
    low = max(0, bits - n.bit_length())
    # One lower bit of all numbers after another.
    rest = [np.packbits((numbers >> b & 1).astype(bool)) for b in range(low)]
    steps = np.zeros(n + (int(numbers[-1]) >> low) + 1 if n else 0, bool)
    steps[(numbers >> low) + np.arange(n)] = True
    return low, b"".join([*(r.tobytes() for r in rest), np.packbits(steps).tobytes()])


def unpacked(body: bytes, n: int, low: int) -> np.ndarray:
    width = -(-n // 8)
    raw = np.frombuffer(body, np.uint8)
    numbers = (np.flatnonzero(np.unpackbits(raw[low * width :]))[:n] - np.arange(n)) << low
    for b in range(low):
        numbers |= np.unpackbits(raw[b * width : (b + 1) * width], count=n).astype(np.int64) << b
    return numbers


def at_most(numbers: np.ndarray, least: int) -> np.ndarray:
    """Ascending numbers, none of them more than `least` times."""
    kept = np.ones(len(numbers), bool)
    kept[least:] = numbers[least:] != numbers[:-least]
    return numbers[kept]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["at", "n", "low", "body"])


def _lists(batches: Iterable[pa.RecordBatch], bits: int, parts: int, least: int) -> Iterator[pa.RecordBatch]:
    """The numbers of a task as lists, one for each of 2 ** parts ranges and chunk."""
    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        numbers = at_most(np.sort(np.concatenate(held)), least)
        inner = bits - parts
        cuts = np.searchsorted(numbers, np.arange((1 << parts) + 1, dtype=np.int64) << inner)
        rows = []
        for at, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            if hi > lo:
                rows.append((at, hi - lo, *packed(numbers[lo:hi] & ((1 << inner) - 1), inner)))
        yield _rows(rows)

    held, size = [], 0
    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        held.append(numbers)
        size += len(numbers)
        if size >= CHUNK:
            yield from told(held)
            held, size = [], 0
    if size:
        yield from told(held)


def frequent(numbers: DataFrame, bits: int, least: int, expected: int) -> tuple[DataFrame, int]:
    """at, n, low, body: stored lists of those numbers (one column of longs from 0 to below
    2 ** bits, no nulls) that occur at least `least` times, by ranges that about CHUNK of the
    `expected` numbers fall into; and the bits inside a range."""
    parts = min(bits, (max(expected, 1) // CHUNK).bit_length())
    lists = numbers.mapInArrow(lambda batches: _lists(batches, bits, parts, least), LIST)

    def often(table: pa.Table) -> pa.Table:
        meet = np.sort(np.concatenate([
            unpacked(body, n, low) for n, low, body in zip(*(table.column(c).to_pylist() for c in ("n", "low", "body")))]))
        ends = np.flatnonzero(np.append(meet[1:] != meet[:-1], True))
        found = meet[ends[np.diff(ends, prepend=-1) >= least]]
        return pa.Table.from_batches([_rows([(table.column("at")[0].as_py(), len(found), *packed(found, bits - parts))])])

    return durable(lists.groupBy("at").applyInArrow(often, LIST)), bits - parts


def bit_filter(lists: DataFrame, bits: int, inner: int, slots: int) -> DataFrame:
    """f: one row, an array of 64-bit words with the bits of both slots of each listed number."""
    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots // 8, np.uint8)
        for batch in batches:
            for at, n, low, body in zip(*(c.to_pylist() for c in batch.columns)):
                numbers = unpacked(body, n, low) | at << inner
                for place in (numbers & (slots - 1), numbers >> bits - slots.bit_length() + 1):
                    for b in range(8):
                        held[place[place & 7 == b] >> 3] |= np.uint8(1 << b)
        words = pa.array(held.view("<i8"))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], names=["f"])

    return lists.coalesce(1).mapInArrow(fill, "f array<long>")


def may_hold(words: Column, number: Column, bits: int, slots: int) -> Column:
    """Whether both slots of the number are set in a filter; its lowest bits name one, its
    highest ones the other."""
    def is_set(slot: Column) -> Column:
        return F.bit_get(F.get(words, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    return is_set(number.bitwiseAND(F.lit(slots - 1))) & is_set(F.shiftright(number, bits - slots.bit_length() + 1))
