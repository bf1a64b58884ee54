"""Exact n-gram Jaccard join by rare-first prefix filtering.

A text's set holds the hashes of its word n-grams.  All sets are ordered by one
global order, rare n-grams first (counts over all texts in a table of fixed size;
any order is right, a rare-first one makes short lists).  Two sets of similarity t
share an n-gram among the first n - ceil(t n) + 1 of each, so only these prefixes
are shuffled, by n-gram.  The length filter and the positional filter drop pairs in
the join, and two suffix filters before the sets are compared: the parity bits of a
set's hashes, of which two sets cannot differ in more places than they have unlike
members, and a recursive split at common values.  Every pair left is verified once, on
the whole sets.

Equal sets are one node from the start.  A list of m texts with one n-gram may hold
a group of near copies, so its pairs are not written out.  First every set is verified only with
the next one in each list (by size, then set) and with the list's set of least place, the
one with fewest rare n-grams of its own: mostly the text that the others were copied
from.  These links make large groups one component at a cost in proportion to the lists.
Then all remaining pairs between *different* components are made and verified.  Pairs
within a component change nothing and are never made; no link between components is lost.

Nulls and edges: words are runs without blanks, A-Z folded.  A null text or one
without words has an empty set and is linked with nothing.  A text of fewer words
than n has one n-gram, its whole sequence.  Rows of equal id and text are one
document.  Ties do not arise: the smallest id names a component.  Other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import (
    SLICES, Spans, chunks, components, marks, merged, mix, row_key, slices, slot_of, texts_of,
)
from chatloom.session import durable

#: Slots of the count table and of the filter of texts to be compared.
COUNTS, MARKS = 1 << 23, 1 << 24
#: Places a task notes before it counts them, and the most that a count tells.
NOTED, MOST = 1 << 21, 65535
#: Sets a task remembers so as not to emit their prefixes again.
REMEMBERED = 500_000
#: Longs of parity bits per set; bits of an n-gram that name its list (a list of two
#: n-grams is only longer).
PARITY, GRAM_BITS = 16, 40

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xD1342543DE82EF95)


def gram_sets(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    low = _LOWER[data]
    inside = ~_BLANK[low]
    # Words end where a text ends.
    first = np.zeros(len(low) + 1, bool)
    first[at] = True
    start = np.flatnonzero(inside & (first[:-1] | ~np.append(False, inside[:-1])))
    last = inside & (first[1:] | ~np.append(inside[1:], False))
    end = np.flatnonzero(last) + 1
    words = Spans(low).hash(start, end)
    bound = np.searchsorted(start, at)
    rolled = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for i in range(n):
        rolled = rolled * _STEP + words[i : i + len(rolled)]
    rolled = rolled ^ (rolled >> np.uint64(32))
    out = []
    for a, b in zip(bound, bound[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            whole = hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity(grams: np.ndarray) -> list[int]:
    """For each of the hash's values mod 64 * PARITY, whether an odd number of members has it."""
    odd = np.bincount((mix(grams) >> np.uint64(64 - (64 * PARITY - 1).bit_length())).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def name_of(grams: np.ndarray) -> int:
    """One number per set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of counts, no larger than a count may be."""
    return np.minimum(x.astype(np.uint32) + y, MOST).astype(np.uint16)


def _survey(docs: DataFrame, key: str, n: int) -> DataFrame:
    """Per row its set's size and name; and per task the counts of its n-grams."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        counts = np.zeros(COUNTS, np.uint16)
        noted, fields = [], None

        def count():
            nonlocal counts
            if noted:
                slot, times = np.unique(np.concatenate(noted), return_counts=True)
                counts[slot] = _plus(counts[slot], np.minimum(times, MOST))
                noted.clear()

        for batch in chunks(batches, "text"):
            fields = batch.schema.field(key).type
            sets = gram_sets(*texts_of(batch.column("text")), n)
            noted.append(slot_of(np.concatenate(sets), COUNTS).astype(np.uint32))
            if sum(map(len, noted)) > NOTED:
                count()
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([name_of(s) for s in sets], pa.int64()), pa.array(map(parity, sets), pa.list_(pa.int64())),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                [key, "row", "n", "ref", "odd", "place", "counts"])
        if fields is not None:
            count()
            made = slices(counts)
            m = made.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, fields), *(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.list_(pa.int64())),
                 made.column(0), made.column(1)],
                [key, "row", "n", "ref", "odd", "place", "counts"])

    return docs.mapInArrow(work, f"`{key}` {kind}, row long, n long, ref long, odd array<long>, place int, counts binary")


def _postings(docs: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """(gram, ref, at) of every set's prefix; `at` is the set's size, then the place."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def work(batches):
        often, seen = sent.value, set()
        for batch in chunks(batches, "text"):
            grams, refs, places = [], [], []
            for s in gram_sets(*texts_of(batch.column("text")), n):
                size, ref = len(s), name_of(s)
                if not size or ref in seen:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(ref)
                prefix = size - -(-percent * size // 100) + 1
                frequency = often[slot_of(s, COUNTS)]
                front = np.lexsort((s, frequency))[:prefix]
                grams.append(s[front] >> np.uint64(64 - GRAM_BITS))
                refs += [ref] * prefix
                places.append(np.arange(prefix) + (size << 32))
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams).view(np.int64)), pa.array(refs, pa.int64()),
                     pa.array(np.concatenate(places))], ["gram", "ref", "at"])

    return docs.select("text").mapInArrow(work, "gram long, ref long, at long")


def _near(percent: int) -> str:
    """Length filter and positional filter: pairs whose sizes and places still allow
    an overlap of percent / (100 + percent) of both sizes together.  At the first n-gram
    that two sets share, all before it in either are unlike members, which bounds the
    sum of both places; a pair is made there, and at few n-grams besides."""
    return (
        f"{100 + percent} * (a_pos + b_pos) <= {100 - percent} * (a_size + b_size) and "
        f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size) and "
        f"{100 + percent} * least(a_size - a_pos, b_size - b_pos) >= {percent} * (a_size + b_size)"
    )


def _alike(percent: int) -> str:
    """Suffix filter on parity bits: sets that differ in more bits than unlike members allow are apart."""
    bits = " + ".join(f"bit_count(a_odd[{i}] ^ b_odd[{i}])" for i in range(PARITY))
    return f"{100 + percent} * ({bits}) <= {100 - percent} * sizes"


def _level(size: Column | str) -> Column:
    """Sizes by their logarithm: five levels double a size."""
    return F.floor(F.log2(size) * 5).cast("int")


def _across(named: DataFrame, percent: int) -> DataFrame:
    """Pairs of (component, level) in one list that can hold a pair near enough.

    Of all sets of one component, level and list it is enough to know the sizes' range
    and the most overlap one of them has left; that bounds the sizes, so the levels, of
    its partners.  Joining by list and level keeps sets that cannot meet apart before
    any pair is made: of many unlike texts around one passage hardly any pair remains."""
    parts = named.groupBy("gram", "component", "level").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.min("pos").alias("pos"), F.max(F.col("size") - F.col("pos")).alias("left"))
    least = f"low * {percent / 100 - 1e-9}"
    most = f"least(high * {100 / percent + 1e-9}, left * {(100 + percent) / percent + 1e-9} - low)"
    parts = parts.selectExpr("*", f"{least} as least", f"{most} as most").where("most >= least and most >= 1").select(
        "gram", "component", "level", "low", "high", "pos", "left", _level(F.greatest("least", F.lit(1.0))).alias("from"), _level("most").alias("to"))
    side = lambda x, *more: parts.select(
        "gram", F.col("component").alias(f"{x}_part"), *(F.col(c).alias(f"{x}_{c}") for c in ("low", "high", "pos", "left")), *more)
    a = side("a", F.col("level").alias("a_level"), F.explode(F.sequence("from", "to")).alias("b_level"))
    b = side("b", F.col("level").alias("b_level"), "from", "to")
    pairs = a.join(b, ["gram", "b_level"]).where(
        f"a_part < b_part and a_level between `from` and `to` and "
        f"{100 + percent} * (a_pos + b_pos) <= {100 - percent} * (a_high + b_high) and "
        f"{100 + percent} * least(a_left, b_left) >= {percent} * (a_low + b_low)")
    return pairs.select("gram", "a_part", "a_level", "b_part", "b_level")


def _apart(x: np.ndarray, y: np.ndarray, most: int, low: int = 0, high: int = 1 << 64, depth: int = 0) -> int:
    """Suffix filter: a lower bound of the number of members that only one set has.
    Both are split at the same value; sizes of the parts must match up."""
    bound = abs(len(x) - len(y))
    if bound > most or depth == 4 or min(len(x), len(y)) < 8:
        return bound
    middle = (low + high) // 2
    i, j = np.searchsorted(x, np.uint64(middle)), np.searchsorted(y, np.uint64(middle))
    left = abs(int(i) - int(j))
    right = abs((len(x) - int(i)) - (len(y) - int(j)))
    if left + right > most:
        return left + right
    left = _apart(x[:i], y[:j], most - right, low, middle, depth + 1)
    return left + _apart(x[i:], y[j:], most - left, middle, high, depth + 1)


def _verified(pairs: DataFrame, docs: DataFrame, sets_: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of set names that are similar enough.

    Only the sets that occur in pairs are made again from their texts; a filter of
    fixed size picks the texts, and one text stands for all with its set."""
    nodes = pairs.select(F.col("a").alias("ref")).union(pairs.select("b")).distinct()
    chosen = sets_.select("ref", "row").join(nodes, "ref")
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(marks(chosen.select("row"), MARKS)))

    def sets(batches):
        keep = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            picked = batch.filter(pa.array(keep[slot_of(batch.column("row").to_numpy().view(np.uint64), MARKS)]))
            for part in chunks([picked], "text"):
                made = gram_sets(*texts_of(part.column("text")), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array([name_of(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())],
                    ["row", "ref", "grams"])

    # Rows that pass the filter by chance go here; of equal rows one stays.
    made = docs.select("row", "text").mapInArrow(sets, "row long, ref long, grams binary")
    made = durable(made.join(chosen, ["row", "ref"], "left_semi").dropDuplicates(["row", "ref"]).select("ref", "grams"))
    a = made.select(F.col("ref").alias("a"), F.col("grams").alias("a_grams"))
    b = made.select(F.col("ref").alias("b"), F.col("grams").alias("b_grams"))

    def compare(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("a_grams"), batch.column("b_grams"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                most = (len(x) + len(y)) * (100 - percent) // (100 + percent)
                if _apart(x, y, most) > most:
                    good.append(False)
                    continue
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_grams", "b_grams").mapInArrow(compare, "a long, b long")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row: the key, `row` (one number per key and text), `n_shingles`,
    `component_id`, the smallest key that links reach, and `component`, a number of the
    component that does not depend on keys (null for an empty set)."""
    docs = docs.select(F.col(key), F.col(text).alias("text"), row_key(key, text).alias("row"))
    survey = durable(_survey(docs, key, n))
    rows = survey.where("n is not null").select(key, "row", "n", "ref")
    counts = merged(survey.where("place is not null").select(*[c.split()[0] for c in SLICES.split(", ")]), COUNTS, np.uint16, _plus)
    full = rows.where("n > 0")
    sets = durable(survey.where("n > 0").groupBy("ref").agg(
        F.min("row").alias("row"), F.min(key).alias("first"), F.max("odd").alias("odd")))

    posted = _postings(docs, counts, n, percent)
    alone = "max(ref) over (partition by gram) = min(ref) over (partition by gram) as alone"
    # Lists of one set go; what stays is read several times.  Sets that several tasks gave are one.
    lists = durable(posted.selectExpr("gram", "ref", "at", alone).where("not alone").select("gram", "ref", "at").distinct())
    lists = lists.selectExpr("gram", "ref", "cast(at >> 32 as int) as size", "cast(at & 4294967295 as int) as pos")

    pair = ["a", "b"]

    def alike(pairs):
        """Those pairs that the parity bits leave; only the bits of their sets are dealt out."""
        pairs = durable(pairs)
        nodes = pairs.select(F.col("a").alias("ref")).union(pairs.select("b")).distinct()
        bits = durable(sets.select("ref", "odd").join(nodes, "ref", "left_semi"))
        odd = lambda x: bits.select(F.col("ref").alias(x), F.col("odd").alias(f"{x}_odd"))
        return durable(pairs.join(odd("a"), "a").join(odd("b"), "b").where(_alike(percent)).select(*pair))

    beside = lists.selectExpr(
        "*", "array(lead(struct(ref, size, pos)) over (partition by gram order by size, ref), "
             "min_by(struct(ref, size, pos), struct(pos, size, ref)) over (partition by gram)) as others")
    beside = beside.select("*", F.explode("others").alias("next")).where("next.ref <> ref").selectExpr(
        "ref as a", "next.ref as b", "size as a_size", "pos as a_pos", "next.size as b_size", "next.pos as b_pos")
    near = beside.where(_near(percent)).select(
        F.least(*pair).alias("a"), F.greatest(*pair).alias("b"), (F.col("a_size") + F.col("b_size")).alias("sizes")).distinct()
    near = alike(near)
    links = durable(_verified(near, docs, sets, n, percent))
    groups = durable(components(links))

    named = lists.select("gram", "ref", "size", "pos").join(groups.withColumnRenamed("node", "ref"), "ref", "left").select(
        "gram", F.coalesce("component", "ref").alias("component"), "ref", "size", "pos", _level("size").alias("level"))
    # Of each list what remains are sets of several components.
    several = "min(component) over (partition by gram) < max(component) over (partition by gram) as several"
    named = durable(named.selectExpr("*", several).where("several").drop("several"))
    across = _across(named, percent)
    side = lambda x: named.select("gram", *(F.col(c).alias(f"{x}_{d}") for c, d in
                                            (("component", "part"), ("level", "level"), ("ref", "ref"), ("size", "size"), ("pos", "pos"))))
    wide = across.join(side("a"), ["gram", "a_part", "a_level"]).join(side("b"), ["gram", "b_part", "b_level"]).where(_near(percent))
    rest = wide.select(F.least("a_ref", "b_ref").alias("a"), F.greatest("a_ref", "b_ref").alias("b"),
                       (F.col("a_size") + F.col("b_size")).alias("sizes")).distinct()
    rest = alike(rest.join(near, pair, "left_anti"))
    if not rest.isEmpty():
        more = durable(_verified(rest, docs, sets, n, percent))
        if not more.isEmpty():
            groups = durable(components(links.union(more)))

    sets = sets.join(groups.withColumnRenamed("node", "ref"), "ref", "left")
    sets = sets.select("ref", "first", F.coalesce("component", "ref").alias("component"))
    smallest = sets.groupBy("component").agg(F.min("first").alias("component_id"))
    names = sets.join(smallest, "component").select("ref", "component_id", "component")
    linked = full.join(names, "ref").select(key, "row", F.col("n").alias("n_shingles"), "component_id", "component")
    alone = rows.where("n = 0").select(
        key, "row", F.col("n").alias("n_shingles"), F.col(key).alias("component_id"), F.lit(None).cast("long").alias("component"))
    return linked.unionByName(alone)
