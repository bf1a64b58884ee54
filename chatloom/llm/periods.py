"""Periodic stretches of words, found by queries for occurrences inside the text.

A run of smallest period q is a maximal stretch in which words q apart are equal.  Take
the power of two L with L/2 < q <= L.  A run of at least four periods contains a block of
L words that begins at a multiple of L, and the block occurs again exactly q words further
on or back.  So it is enough to ask, for every such dyadic block, for the occurrences next
to it in both neighbouring windows of L words; occurrences closer than L to each other
form an arithmetic progression whose difference is the candidate period.

The occurrences of a block are a range of the suffix array.  Prefix doubling sorts the
suffixes and passes every L on its way, where the blocks of L words that occur twice and
their ranges are read off.  A wavelet matrix over the suffix array then answers "next
larger" and "next smaller place in this range" for all blocks at once.  Each progression is
extended in both directions by comparing words, once per run.

Texts are taken about a megabyte at a time; words of different texts are different
symbols, so nothing crosses texts and all texts share one suffix array and one matrix.
Memory follows the longest text.  No shuffle; a retried task gives the same rows.

Nulls and edges: a null text is empty; texts without words have no runs.  A null id counts
as empty text.  Repeated rows get equal answers.  Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatloom.llm.common import chunks

Run = tuple[int, int, int]  # start, length, period


def is_run(length: int, period: int) -> bool:
    """The shortest stretch that counts: four periods, and six words."""
    return length >= max(6, 4 * period)


class Wavelet:
    """A wavelet matrix over an array of places; answers many range queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            low = (values >> b & 1) == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(low, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate((values[low], values[~low]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each range [lo, hi) are smaller than x."""
        out = np.zeros(len(x), np.int64)
        for b, before in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, z = before[lo], before[hi]
            one = (x >> b & 1).astype(bool)
            out += np.where(one, z - a, 0)
            lo = np.where(one, before[-1] + lo - a, a)
            hi = np.where(one, before[-1] + hi - z, z)
        return out

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with n smaller ones in each range."""
        out = np.zeros(len(n), np.int64)
        for b, before in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, z = before[lo], before[hi]
            one = n >= z - a
            n = np.where(one, n - (z - a), n)
            out |= one.astype(np.int64) << b
            lo = np.where(one, before[-1] + lo - a, a)
            hi = np.where(one, before[-1] + hi - z, z)
        return out


def blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Sort suffixes by prefix doubling.  Returns the places in the suffix array whose
    first two symbols occur again, the suffixes there, and for each power of two L the
    aligned blocks of L symbols that occur again: (L, start, range from, range to).
    Every text must end with a symbol of its own."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n, np.int64)
    slots = np.arange(n)
    keys, suffixes = symbols[order], order
    array, found, kept, size = order, [], None, 1
    while True:
        # Slots of one group lie side by side; a group's rank is its first slot.
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(heads, len(keys)))
        first = np.repeat(slots[heads], lengths)
        rank[suffixes] = first
        again = np.repeat(lengths > 1, lengths)
        if size > 1:
            asked = again & (suffixes % size == 0)
            if asked.any():
                span = np.repeat(lengths, lengths)
                found.append((size, suffixes[asked], first[asked], first[asked] + span[asked]))
        slots, suffixes = slots[again], suffixes[again]
        if size == 2:
            kept = slots
        if not len(slots):
            break
        keys = rank[suffixes] * n + rank[suffixes + size]
        sort = np.argsort(keys, kind="stable")
        keys, suffixes = keys[sort], suffixes[sort]
        array[slots] = suffixes
        size *= 2
    if kept is None:
        kept = np.zeros(0, np.int64)
    return kept, array[kept], found


def candidates(symbols: np.ndarray) -> np.ndarray:
    """(period, start) rows of neighbouring occurrences of dyadic blocks."""
    kept, suffixes, found = blocks(symbols)
    if not found:
        return np.zeros((0, 2), np.int64)
    tree = Wavelet(suffixes)
    # One batch of queries for all block lengths; ranges are counted among the kept places.
    size = np.concatenate([np.full(len(j), L, np.int64) for L, j, _, _ in found])
    j = np.concatenate([x for _, x, _, _ in found])
    lo = np.searchsorted(kept, np.concatenate([x for _, _, x, _ in found]))
    hi = np.searchsorted(kept, np.concatenate([x for _, _, _, x in found]))
    before = tree.below(lo, hi, j)
    out = []
    more = before + 1 < hi - lo
    after = tree.nth(lo[more], hi[more], before[more] + 1)
    near = after - j[more] <= size[more]
    out.append(np.column_stack(((after - j[more])[near], j[more][near])))
    less = before > 0
    ahead = tree.nth(lo[less], hi[less], before[less] - 1)
    near = j[less] - ahead <= size[less]
    out.append(np.column_stack(((j[less] - ahead)[near], ahead[near])))
    return np.unique(np.concatenate(out), axis=0)


def reach(symbols: np.ndarray, at: int, period: int, way: int) -> int:
    """How far equality of symbols `period` apart goes on from `at`, forwards or backwards."""
    limit = len(symbols) - period - at if way > 0 else at + 1
    gone, step = 0, 32
    while gone < limit:
        size = min(step, limit - gone)
        a = at + gone if way > 0 else at - gone - size + 1
        same = symbols[a : a + size] == symbols[a + period : a + period + size]
        if not same.all():
            return gone + int((same if way > 0 else same[::-1]).argmin())
        gone += size
        step *= 2
    return gone


def runs_of(symbols: np.ndarray) -> list[Run]:
    """All runs of the symbols, by period, then start."""
    out: list[Run] = []
    rows = candidates(symbols)
    if not len(rows):
        return out
    periods = rows[:, 0]
    cuts = np.flatnonzero(np.append(True, periods[1:] != periods[:-1])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
        period, starts = int(periods[a]), rows[a:b, 1].tolist()
        i = 0
        while i < len(starts):
            at = starts[i]
            ahead = reach(symbols, at, period, 1)
            start = at - reach(symbols, at - 1, period, -1) if at else at
            end = at + ahead + period
            if is_run(end - start, period):
                out.append((start, end - start, period))
            # Occurrences that begin in this stretch and have their next one in it belong to it.
            i = bisect_right(starts, at + ahead - 1, i + 1)
    return out


def symbols_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One number per word, equal for equal words of one text only, and after each text
    one of its own; and where each text begins."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(words) + 1 for words in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    numbers = np.zeros(int(begin[-1]), np.int64)
    for words, at in zip(texts, begin.tolist(), strict=False):
        numbers[at : at + len(words)] = [known.setdefault(w, len(known) + 1) for w in words]
    return np.repeat(np.arange(len(texts)), sizes) * (len(known) + 1) + numbers, begin


def find(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    if not texts:
        return out
    symbols, begin = symbols_of(texts)
    found = runs_of(symbols)
    places = np.searchsorted(begin, np.array([s for s, _, _ in found], np.int64), "right") - 1
    for (start, length, period), text in zip(found, places.tolist(), strict=True):
        out[text].append((start - int(begin[text]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact length / period; of equals the first, then the
    smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that repeat an earlier period of some run."""
    if not runs:
        return b" ".join(words)
    level = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        level[start + period] += 1
        level[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(level[:-1]) == 0).tolist()))


RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def table(docs: DataFrame, key: str = "doc_id", text: str = "text",
          cut: Callable[[object, bytes], list[bytes]] | None = None) -> DataFrame:
    """Per row: `runs` by start and period, the `strongest` of them, and the text with
    every run collapsed to its first period.  `cut` turns a row's id and UTF-8 text into
    words; without it they are what ASCII blanks separate."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        for batch in chunks(batches, text):
            keys = batch.column(key)
            raws = batch.column(text).cast(pa.binary()).to_pylist()
            words = [(raw or b"").split() if cut is None else cut(name, raw or b"")
                     for name, raw in zip(keys.to_pylist(), raws, strict=True)]
            found = find(words)
            as_row = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([[as_row(r) for r in runs] for runs in found], pa.list_(_RUN)),
                 pa.array([as_row(strongest(runs)) for runs in found], _RUN),
                 pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.binary()).cast(pa.string())],
                [key, "runs", "strongest", "collapsed"])

    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, runs array<{RUN}>, strongest {RUN}, collapsed string")
