"""Nearest neighbours by a forest of random-projection trees.

The trees are grown on a bounded sample: a node splits its points by the plane
halfway between two of them.  Every vector of the table goes to one leaf of each
tree, by the planes alone; leaves that then hold more than `LEAF_ROWS` are split on,
round by round, by planes between some of their own vectors, until none is left or
no plane is found.  A query keeps one priority queue over the nodes of *all*
trees: the margin by which it misses a node's side is the node's priority, so the
search opens whichever leaf of whichever tree is most promising, until the leaves
opened hold `candidates` vectors, more of them in larger tables, and every tree has had `LEAST` of its leaves opened, so
that no crowded leaf ends it early.  Candidates of the opened leaves are ranked by
their exact cosine; the best k of each leaf and query go on, and the best k of those
are the answer.

Equal vectors are one entry with their k + 1 smallest ids: no more can appear in an
answer, and no leaf can be full of equals.  Leaves and the queries at a leaf are cut
into blocks of bounded size; only best-k lists leave a block.

Nulls and edges: vectors that are null, zero, or hold null or non-finite components
neither ask nor answer.  Vectors of different lengths have no cosine; each length, of which
a table has few, is searched on its own.  Equal scores go to the smaller id.  With fewer than k other
vectors all are returned.  Repeated ids are separate rows; a query skips rows of its
own id.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.vectors import matrix, unit, valid
from chatloom.session import durable

TREES, LEAF, SAMPLE = 12, 48, 20_000
#: Vectors that a query's opened leaves hold, counted once per tree they are found in, in a
#: table of `USUAL` vectors or fewer; beyond, the number grows with this power of the table.
CANDIDATES, USUAL, GROWTH = 12_000, 20_000, 0.75
#: Vectors a leaf may hold before it is split on, those that its planes are drawn from,
#: rounds that may pass without a plane for any leaf, leaves that every tree must open.
LEAF_ROWS, DRAWN, IDLE, LEAST = 1024, 24, 3, 4
BLOCK = 4096


@dataclass
class Forest:
    """All trees in one numbering.  A node has a plane and two children; a negative
    child is the leaf -1 - child."""

    normal: np.ndarray
    offset: np.ndarray
    child: np.ndarray
    roots: list[int]
    leaves: int

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(rows), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(rows), root)
            while len(live := np.flatnonzero(at >= 0)):
                node = at[live]
                side = (rows[live] * self.normal[node]).sum(axis=1) > self.offset[node]
                at[live] = self.child[node, side.astype(int)]
            out[:, t] = -1 - at
        return out

    def open(self, margins: np.ndarray, held: np.ndarray, wanted: int, least: int = 0) -> list[int]:
        """The leaves to look at, best first, given a query's margin at every node."""
        queue = [(-np.inf, root, tree) for tree, root in enumerate(self.roots)]
        heapq.heapify(queue)
        leaves, total, opened, lacking = [], 0, [0] * len(self.roots), len(self.roots) if least else 0
        margin, child = margins.tolist(), self.child
        while queue and (total < wanted or lacking):
            far, node, tree = heapq.heappop(queue)
            if total >= wanted and opened[tree] >= least:
                continue
            while node >= 0:
                m = margin[node]
                heapq.heappush(queue, (max(far, abs(m)), int(child[node, 0 if m > 0 else 1]), tree))
                node = int(child[node, 1 if m > 0 else 0])
            if size := int(held[-1 - node]):
                leaves.append(-1 - node)
                total += size
                opened[tree] += 1
                lacking -= opened[tree] == least
        return leaves

    def split(self, samples: dict[int, np.ndarray], leaf: int, seed: int) -> Forest:
        """The forest with these leaves split on, by planes between their samples.  A
        leaf's number goes to the first of its parts."""
        rng, numbers = np.random.default_rng(seed), count(self.leaves)
        normal, offset, child, roots = list(self.normal), self.offset.tolist(), self.child.tolist(), list(self.roots)
        above = {c: (i, side) for i, pair in enumerate(child) for side, c in enumerate(pair) if c < 0}
        for name in sorted(samples):
            top = _subtree(samples[name], np.arange(len(samples[name])), leaf, rng, normal, offset, child, chain([name], numbers))
            if (-1 - name) in above:
                i, side = above[-1 - name]
                child[i][side] = top
            else:
                roots[roots.index(-1 - name)] = top
        return _forest(normal, offset, child, roots, next(numbers), next(iter(samples.values())).shape[1])


def _forest(normal, offset, child, roots, leaves: int, width: int) -> Forest:
    return Forest(
        np.array(normal).reshape(len(normal), width), np.array(offset),
        np.array(child, np.int64).reshape(len(child), 2), roots, leaves)


def _subtree(sample: np.ndarray, members: np.ndarray, leaf: int, rng, normal, offset, child, numbers: Iterator[int]) -> int:
    """Append the nodes that split the members, down to `leaf` of them; the top node."""
    for _ in range(4 if len(members) > leaf else 0):
        a, b = sample[rng.choice(members, 2, replace=False)]
        plane = a - b
        if not plane.any():
            continue
        cut = float(plane @ (a + b)) / 2
        side = sample[members] @ plane > cut
        if 0.05 < side.mean() < 0.95:
            here = len(normal)
            size = np.linalg.norm(plane)
            normal.append(plane / size)
            offset.append(cut / size)
            child.append([0, 0])
            below = [_subtree(sample, part, leaf, rng, normal, offset, child, numbers) for part in (members[~side], members[side])]
            child[here] = below
            return here
    return -1 - next(numbers)


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
    rng, numbers = np.random.default_rng(seed), count()
    normal, offset, child = [], [], []
    roots = [_subtree(sample, np.arange(len(sample)), leaf, rng, normal, offset, child, numbers) for _ in range(trees if len(sample) else 0)]
    return _forest(normal, offset, child, roots, next(numbers), sample.shape[1] if sample.ndim == 2 else 0)


def _bounded(nodes: DataFrame, forest: Forest) -> tuple[Forest, np.ndarray]:
    """The forest with overfull leaves split over all rows, and what its leaves hold.  It
    has about one plane for every LEAF_ROWS / 2 vectors and tree beyond the sample's."""
    context = nodes.sparkSession.sparkContext
    idle = turn = 0
    while True:
        sent = context.broadcast(forest)

        def leaves(batches, sent=sent):
            for batch in batches:
                f = sent.value
                leaf = f.place(unit(matrix(batch.column("raw")))) if batch.num_rows else np.zeros((0, len(f.roots)), np.int64)
                at = pa.array(np.repeat(np.arange(batch.num_rows), leaf.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), batch.column("node").take(at), batch.column("raw").take(at)], ["leaf", "node", "raw"])

        placed = nodes.select("node", "raw").mapInArrow(leaves, "leaf long, node long, raw binary")
        # One number per leaf.
        held = np.zeros(forest.leaves + 1, np.int64)
        for leaf, n in placed.groupBy("leaf").count().collect():
            held[leaf] = n
        over = np.flatnonzero(held > LEAF_ROWS).tolist()
        if not over or idle == IDLE:
            return forest, held
        wanted = F.broadcast(nodes.sparkSession.createDataFrame([(i,) for i in over], "leaf long"))
        drawn = placed.join(wanted, "leaf").withColumn("order", F.xxhash64("node", "leaf", F.lit(turn)))
        drawn = drawn.selectExpr("leaf", "raw", "row_number() over (partition by leaf order by order, node) as place").where(F.col("place") <= DRAWN)
        raws: dict[int, list[bytes]] = {}
        for leaf, raw in drawn.select("leaf", "raw").collect():
            raws.setdefault(leaf, []).append(bytes(raw))
        samples = {leaf: unit(np.array([np.frombuffer(r) for r in sorted(own)])) for leaf, own in raws.items()}
        before, turn = forest.leaves, turn + 1
        forest = forest.split(samples, DRAWN // 4, turn)
        idle = 0 if forest.leaves > before else idle + 1


def search(df: DataFrame, asks: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
           candidates: int = CANDIDATES, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest other rows found for each row that asks."""
    given = df.select(F.col(key).cast("long").alias("id"), asks.alias("asks"), F.col(vector).alias("v"))
    sizes = sorted(r[0] for r in given.where("v is not null and size(v) > 0").select(F.size("v")).distinct().collect())
    found = [_search(given.where(F.size("v") == n), k, key, candidates, trees, sample) for n in sizes or [0]]
    return reduce(DataFrame.unionByName, found)


def _search(given: DataFrame, k: int, key: str, candidates: int, trees: int, sample: int) -> DataFrame:
    """The same among vectors of one length: id, asks, v."""
    rows = valid(given, "v", every_length=True)
    rows = durable(rows.withColumn("node", F.xxhash64("raw")))
    # Of equal vectors the k + 1 smallest ids can be in an answer.
    few = rows.selectExpr("node", "raw", "id", "row_number() over (partition by node, raw order by id) as place").where(F.col("place") <= k + 1)
    nodes = durable(few.groupBy("node", "raw").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    there = nodes.count()
    picked = nodes if there <= sample else nodes.where(F.pmod("node", F.lit(1_000_000)) < int(1_000_000 * sample / there))
    raws = sorted(bytes(r.raw) for r in picked.select("raw").limit(2 * sample).collect())
    forest = grow(unit(np.array([np.frombuffer(r) for r in raws])), trees)
    context = given.sparkSession.sparkContext
    budget = int(candidates * max(1.0, there / USUAL) ** GROWTH)
    forest, held = _bounded(nodes, forest)
    sent = context.broadcast(forest)

    def index(batches):
        f = sent.value
        for batch in batches:
            leaf = f.place(unit(matrix(batch.column("raw")))) if batch.num_rows else np.zeros((0, len(f.roots)), np.int64)
            at = np.repeat(np.arange(batch.num_rows), leaf.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf.ravel()), *(batch.column(c).take(pa.array(at)) for c in ("node", "raw", "ids"))],
                ["leaf", "node", "raw", "ids"])

    members = nodes.select("node", "raw", "ids").mapInArrow(index, "leaf long, node long, raw binary, ids array<long>")
    counts = context.broadcast(held)

    def ask(batches):
        f, sizes = sent.value, counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                q = unit(matrix(part.column("raw")))
                margins = q @ f.normal.T - f.offset if len(f.offset) else np.zeros((len(q), 0))
                opened = [f.open(m, sizes, budget, LEAST) for m in margins]
                take = np.repeat(np.arange(len(q)), [len(o) for o in opened])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for o in opened for x in o], pa.int64()),
                     *(part.column(c).take(pa.array(take)) for c in ("node", "raw"))], ["leaf", "node", "raw"])

    queries = rows.where("asks").select("node", "raw").distinct()
    asked = durable(queries.mapInArrow(ask, "leaf long, node long, raw binary"))
    asking = np.zeros(forest.leaves + 1, np.int64)
    for leaf, n in asked.groupBy("leaf").count().collect():
        asking[leaf] = n
    blocks = context.broadcast((-(-held // BLOCK), -(-asking // BLOCK)))

    def dealt(own: int):
        """Rows of a leaf go to one row or column of its grid of blocks, and to all
        blocks of the other direction."""
        def work(batches):
            mine, others = blocks.value[own], blocks.value[1 - own]
            for batch in batches:
                leaf = batch.column("leaf").to_numpy()
                node = batch.column("node").to_numpy().view(np.uint64)
                times = others[leaf]
                at = np.repeat(np.arange(len(leaf)), times)
                line = (node % np.maximum(mine[leaf], 1).astype(np.uint64)).astype(np.int64)[at]
                across = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                cell = pa.array(line << 24 | across if own == 0 else across << 24 | line, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [cell, *(c.take(pa.array(at)) for c in batch.columns)], ["cell", *batch.schema.names])
        return work

    left = members.mapInArrow(dealt(0), "cell long, leaf long, node long, raw binary, ids array<long>")
    right = asked.mapInArrow(dealt(1), "cell long, leaf long, node long, raw binary")

    def rank(have: pa.Table, want: pa.Table) -> pa.Table:
        out_node, out_ids, out_score = [], [], []
        if have.num_rows and want.num_rows:
            x, y = matrix(have.column("raw")), matrix(want.column("raw"))
            nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            ux, ids = unit(x), have.column("ids").to_pylist()
            keep = min(k + 1, len(x))
            for at in range(0, len(y), 256):
                near = unit(y[at : at + 256]) @ ux.T
                edge = np.partition(near, len(x) - keep, axis=1)[:, len(x) - keep]
                for i, row in enumerate(near):
                    q = at + i
                    for j in np.flatnonzero(row >= edge[i] - 1e-12):
                        out_node.append(q)
                        out_ids.append(ids[j])
                        # The measure itself, on the vectors as they were given.
                        s = float(x[j] @ y[q]) / (float(nx[j]) * float(ny[q]))
                        out_score.append(s if np.isfinite(s) else float(row[j]))
        nodes_ = want.column("node").combine_chunks().take(pa.array(out_node, pa.int64())) if out_node else pa.array([], pa.int64())
        return pa.table({"node": nodes_, "ids": pa.array(out_ids, pa.list_(pa.int64())), "score": pa.array(out_score, pa.float64())})

    scored = left.groupBy("leaf", "cell").cogroup(right.groupBy("leaf", "cell")).applyInArrow(
        rank, "node long, ids array<long>, score double")
    # A vector found in several trees appears once; the smallest id names equal vectors.
    once = scored.groupBy("node", F.col("ids")[0].alias("first")).agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = once.selectExpr("*", "row_number() over (partition by node order by score desc, first) as place").where(F.col("place") <= k + 1)
    listed = best.groupBy("node").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    who = rows.where("asks").select("node", F.col("id").alias("query_id"))
    each = who.join(listed, "node").select("query_id", F.explode("found").alias("f")).select(
        "query_id", F.col("f.score").alias("score"), F.explode("f.ids").alias("id")).where("id <> query_id")
    ranked = each.selectExpr("query_id", "cast(row_number() over (partition by query_id order by score desc, id) as int) as rank", "id", "score")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
