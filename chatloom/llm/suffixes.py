"""Removal of long repeats by a distributed merge sort of suffixes.

A string of `length` bytes that occurs twice contains the same anchor in both
places: the k-gram with the smallest hash inside it, the leftmost of equals.  So it
is enough to sort the suffixes that begin at anchors, and of those only the ones
whose k-gram occurs again somewhere (a count per k-gram, then a filter of fixed size
without misses).

Each task sorts its suffixes into a run and front-codes it: every key is the length
of the prefix it shares with the one before, and the rest.  Runs are cut at
splitters and exchanged; a loser tree that keeps with every entry the prefix it
shares with the last winner merges the runs of a range, so bytes known to be equal
are never compared again, and the merged order comes with its common-prefix lengths.
A key is the text from the anchor on, then the text before it read backwards, so
equal surroundings are neighbours and become one entry with a count.

In the merged order, suffixes i and j share the smallest prefix length r between
them; together with the l bytes they share before the anchor, the strings that start
between `length - r` and l bytes before the anchor are repeated.  Small blocks of one
k-gram compare their members' left sides directly; larger ones group, for every l,
by (equal right side, hash of the left side).  Blocks above `HOT` suffixes are dealt
out by the hash of the surroundings, so no block has to be in one task.  What a part
cannot settle by itself, strings it holds once, goes on in bands of `BAND` neighbouring
strings under the hash of the bytes that the whole band shares; bands that meet no
other are dropped, and only the strings of the rest meet by their own hash.

Nulls and edges: a null text is empty.  Strings do not cross texts.  Texts shorter
than `length` lose nothing.  Rows of equal id and text are separate documents and so
repeat each other.  Strings may overlap, also in one text, and are judged on the
input.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import Spans, chunks, fresh, marks, mix, row_key, slot_of, texts_of
from chatloom.session import durable

LENGTH, ANCHOR = 400, 64
#: Slots of the filters of repeated k-grams, of hot ones, and of changed texts.
SHARED, HOT_SLOTS, CHANGED = 1 << 24, 1 << 20, 1 << 24
#: Blocks above this many suffixes are dealt out; suffixes per range; those that set splitters.
HOT, RANGE, SAMPLE = 40_000, 20_000, 20_000
#: Neighbouring strings that go on together.
BAND = 8
#: Bytes of keys that a run may hold before it is sorted and sent.
RUN_BYTES = 24 << 20
#: Blocks up to this many different surroundings are compared pair by pair; strings of
#: larger ones that are looked at together.
SMALL, CELLS = 12, 1 << 17
PAD = 0xFF  # in no UTF-8 text


class Packed:
    """A filter of fixed size as it travels."""

    def __init__(self, seen: np.ndarray):
        self.slots, self.bits = len(seen), np.packbits(seen)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        slot = slot_of(numbers, self.slots)
        return (self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def anchors(data: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, k-gram hash) of the anchors of all texts, in order."""
    width = length - k + 1
    grams = Spans(data).rolling(k)
    n = len(grams) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    bits = np.uint64(len(grams).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    whole = np.full(-(-len(ranked) // width) * width, ~np.uint64(0))
    whole[: len(ranked)] = ranked
    table = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    inside = np.arange(n) + length <= at[text + 1]
    place, text = least[inside], text[inside]
    if len(place):
        new = np.append(True, place[1:] != place[:-1])
        place, text = place[new], text[new]
    return place, text, grams[place]


# --- runs ----------------------------------------------------------------------

def common(x: bytes, y: bytes, at: int = 0) -> int:
    """The length of the common prefix, given that `at` bytes are known equal."""
    most, step = min(len(x), len(y)), 32
    while at < most:
        if x[at : at + step] == y[at : at + step]:
            at += step
            step *= 2
            continue
        if step <= 4:
            while at < most and x[at] == y[at]:
                at += 1
            return at
        step //= 4
    return most


def write_run(keys: list[bytes], sizes: list[int], refs: list[tuple[int, int]]) -> bytes:
    """Front-code sorted keys: shared prefix, rest, right side's length, and whose it is."""
    rests, shared, before = [], np.zeros(len(keys), np.uint16), b""
    for i, key in enumerate(keys):
        h = shared[i] = common(before, key)
        rests.append(key[h:])
        before = key
    head = np.array([len(keys)], np.uint32).tobytes()
    columns = (
        shared, np.array([len(r) for r in rests], np.uint16), np.array(sizes, np.uint16),
        np.array([r for r, _ in refs], np.int64), np.array([p for _, p in refs], np.int64),
    )
    return zlib.compress(head + b"".join(c.tobytes() for c in columns) + b"".join(rests), 1)


Entry = tuple[int, bytes, int, int, int]  # shared with the one before, key, right side, row, place


def read_run(raw: bytes) -> Iterator[Entry]:
    raw = zlib.decompress(raw)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at, columns = 4, []
    for kind in (np.uint16, np.uint16, np.uint16, np.int64, np.int64):
        columns.append(np.frombuffer(raw, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    key = b""
    for shared, rest, size, row, place in zip(*columns, strict=True):
        key = key[:shared] + raw[at : at + rest]
        at += rest
        yield shared, key, size, row, place


class LoserTree:
    """Merges runs.  Every entry knows how much it shares with the last winner: of two
    entries the one that shares more comes first, and only equals are compared, from
    the known bytes on."""

    def __init__(self, runs: list[Iterator[Entry]]):
        self.runs = runs
        size = 1
        while size < max(len(runs), 1):
            size *= 2
        self.size = size
        self.shares = [0] * size
        self.entries: list[Entry | None] = [next(runs[i], None) if i < len(runs) else None for i in range(size)]
        self.losers = [0] * size
        self.top = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of two runs; the loser stays at the node with its new share."""
        x, y = self.entries[a], self.entries[b]
        if y is None:
            win, lose = a, b
        elif x is None:
            win, lose = b, a
        else:
            p, q = self.shares[a], self.shares[b]
            if p > q:
                win, lose = a, b
            elif q > p:
                win, lose = b, a
            else:
                h = common(x[1], y[1], p)
                first = x[1][h : h + 1] <= y[1][h : h + 1]
                win, lose = (a, b) if first else (b, a)
                self.shares[lose] = h
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[Entry]:
        while (entry := self.entries[self.top]) is not None:
            run = self.top
            yield self.shares[run], *entry[1:]
            after = next(self.runs[run], None)
            self.entries[run] = after
            self.shares[run] = after[0] if after else 0
            node, now = (run + self.size) // 2, run
            while node:
                now = self._play(node, self.losers[node], now)
                node //= 2
            self.top = now


# --- repeats within a block ----------------------------------------------------

class Block:
    """Suffixes of one k-gram: different surroundings in order, with their owners."""

    def __init__(self, length: int):
        self.length = length
        self.shared: list[int] = []
        self.keys: list[bytes] = []
        self.sizes: list[int] = []
        self.owners: list[list[tuple[int, int]]] = []

    def add(self, shared: int, key: bytes, size: int, row: int, place: int) -> None:
        if self.keys and shared == len(key) == len(self.keys[-1]) and size == self.sizes[-1]:
            self.owners[-1].append((row, place))
        else:
            self.shared.append(shared)
            self.keys.append(key)
            self.sizes.append(size)
            self.owners.append([(row, place)])

    def right(self) -> np.ndarray:
        """Bytes from the anchor on that each shares with the one before."""
        size = np.array(self.sizes)
        out = np.minimum(np.array(self.shared), size)
        out[1:] = np.minimum(out[1:], size[:-1])
        out[0] = 0
        return out

    def lefts(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes before the anchors, nearest first, padded; and how many there are."""
        width = self.length
        n = np.array([len(k) - width for k in self.keys])
        table = np.frombuffer(b"".join(k[width:].ljust(width, b"\xff") for k in self.keys), np.uint8)
        return table.reshape(-1, width), n

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Per surroundings the smallest and the largest start before the anchor of a
        repeated string; the first is above the second if there is none."""
        if len(self.keys) <= SMALL:
            return self._few()
        _, settled = self.settled()
        some = settled.any(axis=1)
        low = np.where(some, settled.argmax(axis=1), self.length + 1)
        return low, np.where(some, settled.shape[1] - 1 - settled[:, ::-1].argmax(axis=1), -1)

    def _few(self) -> tuple[np.ndarray, np.ndarray]:
        m, length, sizes = len(self.keys), self.length, self.sizes
        left = [key[length:] for key in self.keys]
        low, high = [length + 1] * m, [-1] * m
        for i in range(m):
            if len(self.owners[i]) > 1 and len(left[i]) >= length - sizes[i]:
                low[i], high[i] = min(low[i], length - sizes[i]), max(high[i], len(left[i]))
            r = length
            for j in range(i + 1, m):
                r = min(r, self.shared[j], sizes[j], sizes[j - 1])
                if length - r > min(len(left[i]), len(left[j])):
                    continue
                l = common(left[i], left[j])  # noqa: E741
                if length - r <= l:
                    for x in (i, j):
                        low[x], high[x] = min(low[x], length - r), max(high[x], l)
        return np.array(low), np.array(high)

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """Per surroundings and l: whether there is such a string, and whether this
        block holds it twice.  Two members hold the same string if nothing between
        them in order parts their right sides and the bytes before the anchor agree."""
        m, length = len(self.keys), self.length
        left, n = self.lefts()
        size, right = np.array(self.sizes), self.right()
        l = np.arange(int(n.max()) + 1)  # noqa: E741
        valid = (l <= n[:, None]) & (length - l <= size[:, None])
        found = valid & np.array([len(o) > 1 for o in self.owners])[:, None]
        before = np.zeros(m, np.uint64)
        first, last = length - int(right.max()), int(np.sort(n)[-2]) if m > 1 else -1
        weight = np.append(np.uint64(0), _POWERS[: last + 1])
        # Many l side by side: every line of a table is one l, every column a member.
        step = max(1, CELLS // m)
        for start in range(0, last + 1, step):
            l = np.arange(start, min(start + step, last + 1))  # noqa: E741
            sums = (left.T[np.maximum(l - 1, 0)].astype(np.uint64) + np.uint64(1)) * weight[l][:, None]
            sums[0] += before
            sums = np.cumsum(sums, axis=0, out=sums)
            before = sums[-1]
            l, sums = l[l >= first], sums[l >= first]  # noqa: E741
            if not len(l):
                continue
            group = np.cumsum(right < (length - l)[:, None], axis=1).astype(np.uint64)
            both = sums * np.uint64(0x9E3779B97F4A7C15) + group * np.uint64(0xC2B2AE3D27D4EB4F)
            inside = valid.T[l]
            # What is no such string is like nothing else.
            both = np.where(inside, both, np.arange(m, dtype=np.uint64))
            order = np.argsort(both, axis=1)
            ranked = np.take_along_axis(both, order, axis=1)
            same = ranked[:, 1:] == ranked[:, :-1]
            twice = np.zeros(both.shape, bool)
            twice[:, 1:] = same
            twice[:, :-1] |= same
            met = np.empty(both.shape, bool)
            np.put_along_axis(met, order, twice, axis=1)
            found[:, l] |= (met & inside).T
        return valid, found

    def bands(self) -> Iterator[tuple[int, int | None, int, list[int]]]:
        """(hash of what the band shares, member, first l, strings' hashes) of the bands
        of strings that this block holds once; bands it holds twice have no member.
        A string that is not of the kind is 0."""
        valid, found = self.settled()
        length, most = self.length, valid.shape[1]
        told = set()
        for i, key in enumerate(self.keys):
            left = key[length:][::-1]
            spans = Spans(np.frombuffer(left + key[: self.sizes[i]], np.uint8))
            l = np.flatnonzero(valid[i])  # noqa: E741
            hashes = np.zeros(most + BAND, np.uint64)
            # A string may hold several anchors; for each of them it counts apart.
            hashes[l] = mix(spans.hash(len(left) - l, len(left) - l + length) + l.astype(np.uint64))
            once = np.zeros(most + BAND, bool)
            once[:most] = valid[i] & ~found[i]
            twice = np.zeros(most + BAND, bool)
            twice[:most] = found[i]
            for first in range(0, most, BAND):
                band = slice(first, first + BAND)
                here = once[band] | twice[band]
                if not here.any():
                    continue
                # Every string of the band holds these bytes.
                start = len(left) - first
                core = int(spans.hash(np.array([start]), np.array([start + length - BAND + 1])).view(np.int64)[0])
                if once[band].any():
                    yield core, i, first, np.where(once[band], hashes[band], 0).astype(np.uint64).view(np.int64).tolist()
                if twice[band].any():
                    held = np.where(twice[band], hashes[band], 0).astype(np.uint64)
                    if (first, held.tobytes()) not in told:
                        told.add((first, held.tobytes()))
                        yield core, None, first, held.view(np.int64).tolist()


_POWERS = np.random.default_rng(77).integers(1, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


# --- the jobs ------------------------------------------------------------------

def _count(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(gram, times, start): how often each k-gram is an anchor; some show their bytes."""

    def work(batches):
        for batch in chunks(batches, "text"):
            data, at = texts_of(batch.column("text"))
            place, _, grams = anchors(data, at, length, k)
            grams, first, times = np.unique(grams, return_index=True, return_counts=True)
            shown = [data[p : p + k].tobytes() if g % 64 == 0 else None for g, p in zip(grams.tolist(), place[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), pa.array(times), pa.array(shown, pa.binary())], ["gram", "times", "start"])

    counted = docs.select("text").mapInArrow(work, "gram long, times long, start binary")
    return counted.groupBy("gram").agg(F.sum("times").alias("times"), F.max("start").alias("start"))


def _runs(docs: DataFrame, shared: Packed, hot: Packed, splitters: list[bytes], dealt: int, length: int, k: int) -> DataFrame:
    """(part, run): front-coded runs, cut at the splitters; hot blocks are dealt out by
    the hash of their surroundings to parts of their own."""
    import bisect

    sent = docs.sparkSession.sparkContext.broadcast((shared, hot, splitters))
    parts, reach = len(splitters) + 1, length - k

    def work(batches):
        again, busy, cuts = sent.value
        held: list[tuple[int, bytes, int, int, int]] = []
        room = 0

        def send():
            held.sort(key=lambda e: e[:2])
            a = 0
            names, runs = [], []
            while a < len(held):
                b = a
                while b < len(held) and held[b][0] == held[a][0]:
                    b += 1
                part = held[a:b]
                names.append(held[a][0])
                runs.append(write_run([e[1] for e in part], [e[2] for e in part], [e[3:] for e in part]))
                a = b
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(runs, pa.binary())], ["part", "run"])

        for batch in chunks(batches, "text"):
            data, at = texts_of(batch.column("text"))
            rows = batch.column("row").to_pylist()
            place, text, grams = anchors(data, at, length, k)
            keep = again(grams)
            place, text, grams = place[keep], text[keep], grams[keep]
            crowded = busy(grams)
            raw = data.tobytes()
            begin, end = at[text], at[text + 1]
            for p, b, e, t, is_hot in zip(place.tolist(), begin.tolist(), end.tolist(), text.tolist(), crowded.tolist(), strict=True):
                right = raw[p : min(p + length, e)]
                key = right.ljust(length, b"\xff") + raw[max(b, p - reach) : p][::-1]
                part = parts + zlib.crc32(key) % dealt if is_hot else bisect.bisect_right(cuts, right[:k])
                held.append((part, key, len(right), rows[t], p - b))
                room += len(key)
                if room > RUN_BYTES:
                    yield send()
                    room = 0
        if held:
            yield send()

    return docs.select("row", "text").mapInArrow(work, "part int, run binary")


def _found(runs: DataFrame, parts: int, length: int, k: int) -> DataFrame:
    """Merge the runs of each part.  Rows (row, start, end) are covered bytes; rows with
    a `core` are bands of dealt-out blocks, whose strings are still to be counted."""
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]

    def rows(out):
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row", "start", "end", "core", "strings"])

    def told(block: Block, dealt: bool):
        """Batches of what one block tells."""
        if len(block.keys) == 1 and len(block.owners[0]) == 1 and not dealt:
            return
        low, high = block.repeats()
        for lo, hi, owners in zip(low.tolist(), high.tolist(), block.owners, strict=True):
            if hi >= 0:
                for row, place in owners:
                    yield row, place - hi, place - lo + length, None, None
        for core, i, first, strings in block.bands() if dealt else ():
            if i is None:
                yield None, None, None, core, strings
            else:
                row, place = block.owners[i][0]
                yield row, place - first, place - first + length, core, strings

    def blocks(part: int, held: list[bytes]):
        block = None
        for shared, key, size, row, place in LoserTree([read_run(r) for r in held]):
            if block is None or shared < k or len(block.keys) >= HOT:
                # A block that is cut here is told as dealt out, both parts of it.
                cut = block is not None and shared >= k
                if block is not None:
                    yield block, part >= parts or block.cut or cut
                block = Block(length)
                block.cut = cut
            block.add(shared, key, size, row, place)
        if block is not None:
            yield block, part >= parts or block.cut

    def merge(part: int, held: list[bytes]):
        out = []
        for block, dealt in blocks(part, held):
            for x in told(block, dealt):
                out.append(x)
                if len(out) >= 20_000:
                    yield rows(out)
                    out = []
        yield rows(out)

    def work(batches):
        now, held = None, []
        for batch in batches:
            for part, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and held:
                    yield from merge(now, held)
                    held = []
                now = part
                held.append(run)
        if held:
            yield from merge(now, held)

    dealt = runs.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(work, "row long, start long, end long, core long, strings array<long>")


def spans(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(row, start, end) of repeated bytes, overlapping and unsorted."""
    grams = durable(_count(docs, length, k).where("times > 1"))
    total = grams.agg(F.sum("times")).first()[0] or 0
    session = docs.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), total // RANGE)
    shown = grams.where("start is not null").orderBy("gram").limit(SAMPLE).select("start", "times").collect()
    weights = sorted((bytes(r.start), min(r.times, HOT)) for r in shown)
    step, run, splitters = sum(w for _, w in weights) / parts, 0, []
    for start, weight in weights:
        run += weight
        if run >= step and (not splitters or splitters[-1] != start):
            splitters.append(start)
            run = 0
    shared = Packed(marks(grams.select("gram"), SHARED))
    crowded = grams.where(F.col("times") > HOT)
    hot = Packed(marks(crowded.select("gram"), HOT_SLOTS))
    dealt = -(-(crowded.agg(F.sum("times")).first()[0] or 1) // HOT)
    found = durable(_found(_runs(docs, shared, hot, splitters, dealt, length, k), len(splitters) + 1, length, k))
    sure = found.where("core is null").select("row", "start", "end")
    # A band in which the part holds the strings twice counts twice.
    bands = found.where("core is not null").select("row", "start", "core", "strings", F.when(F.col("row").isNull(), 2).otherwise(1).alias("times"))
    met = bands.groupBy("core").agg(F.sum("times").alias("n"), F.count("row").alias("open")).where("n > 1 and open > 0").select("core")
    strings = bands.join(met, "core", "left_semi").select("row", "start", "times", F.posexplode("strings").alias("up", "string"))
    strings = strings.where("string <> 0").withColumn("start", F.col("start") - F.col("up"))
    often = strings.groupBy("string").agg(F.sum("times").alias("n")).where("n > 1").select("string")
    late = strings.where("row is not null").join(often, "string", "left_semi").selectExpr("row", "start", f"start + {length} as end")
    return sure.union(late)


def _merged(pairs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(pairs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cut(raw: bytes, pieces: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in pieces:
        out.append(raw[at:start])
        at = end
    return b"".join(out) + raw[at:]


def _apply(docs: DataFrame, columns: list[str], text: str, length: int, k: int, change, schema) -> DataFrame:
    """Call change(batch, list of removed pieces per row) on all rows.  Rows without
    a repeat stay where they are read; the others meet their spans by row."""
    row, pieces = fresh(docs.columns, "row"), fresh(docs.columns, "pieces")
    docs = docs.select(*columns, row_key(columns[0], text).alias(row))
    found = spans(docs.select(F.col(row).alias("row"), F.col(text).alias("text")), length, k)
    found = durable(found.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(pieces)))
    sent = docs.sparkSession.sparkContext.broadcast(Packed(marks(found.select(row), CHANGED)))

    def split(wanted):
        def work(batches):
            for batch in chunks(batches, text):
                keep = sent.value(batch.column(row).to_numpy().view(np.uint64))
                part = batch.filter(pa.array(keep if wanted else ~keep))
                yield part if wanted else change(part, [[]] * part.num_rows)
        return work

    def joined(batches):
        for batch in chunks(batches, text):
            cuts = [_merged((p["start"], p["end"]) for p in v or ()) for v in batch.column(pieces).to_pylist()]
            yield change(batch.drop_columns([pieces]), cuts)

    still = docs.mapInArrow(split(False), schema)
    moved = docs.mapInArrow(split(True), docs.schema).join(found, row, "left").mapInArrow(joined, schema)
    return still.union(moved)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """Per row: the key, its text's size in bytes, how many are repeated, in how many
    pieces, the digest of what is left, and what is left as text (without the rests of
    characters that were cut apart)."""
    from pyspark.sql.types import StructType

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]

    def change(batch, pieces):
        out = []
        for value, cut in zip(batch.column(text), pieces, strict=True):
            raw = value.as_buffer().to_pybytes() if value.is_valid else b""
            left = _cut(raw, cut)
            out.append((len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, columns, kinds)], [key, *names])

    schema = StructType([docs.schema[key]])
    for name in names[:3]:
        schema = schema.add(name, "long")
    return _apply(docs, [key, text], text, length, k, change, schema.add("kept_sha256", "string").add("kept_text", "string"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """The same rows and columns, their texts without repeated bytes.  Of a character
    that is cut apart nothing stays; a null text stays null."""
    columns, order = [key, text, *(c for c in docs.columns if c not in (key, text))], docs.columns

    def change(batch, pieces):
        texts = [
            _cut(v.as_buffer().to_pybytes(), cut).decode("utf-8", "ignore") if v.is_valid else None
            for v, cut in zip(batch.column(text), pieces, strict=True)
        ]
        i = batch.schema.get_field_index(text)
        return batch.set_column(i, text, pa.array(texts, batch.schema.field(i).type)).select(order)

    return _apply(docs, columns, text, length, k, change, docs.schema)
