"""Exact range join of vectors by pivots.

Unit vectors at cosine c lie sqrt(2 - 2 c) apart, so a cosine threshold is a radius.
Every vector belongs to the cell of its nearest pivot.  By the triangle inequality a
vector y within the radius r of a vector x of cell p has d(y, p) <= d(x, p) + r, and
d(x, p) <= d(x, q) <= d(y, q) + r for y's own pivot q; so y is copied to every cell p
with d(y, p) <= d(y, q) + 2 r, and never further than r beyond the farthest member of
p.  Cells are then joined on their own: all links of x are seen in its home cell.

A cell's members and those copied to it are cut into blocks; a task compares one block
of members with one block of all, and returns a count per member and a spanning forest
of the links, never the pairs.  Equal vectors are one node with a weight.

Nulls and edges: vectors that are null, zero, or hold null or non-finite components,
and rows without a label, link with nothing and are components of their own.  Vectors
of different lengths have no cosine; each length of a label is joined on its own.  Repeated
ids are separate rows, linked if their vectors are.  Pairs at the threshold, to the
last bit of the double product, link.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import components
from chatloom.llm.vectors import matrix, unit, valid
from chatloom.session import durable

#: Pivots in all, vectors that one should stand for, rows of a block.
PIVOTS, CELL, BLOCK = 1024, 2000, 4096
SLACK = 1e-9


def _dealt(cells, own_name: str, other_name: str):
    """Send a row to its line of the cell's grid of blocks, once for each block across."""
    def work(batches):
        for batch in batches:
            mine = batch.column(own_name).to_numpy()
            times = batch.column(other_name).to_numpy()
            node = batch.column("node").to_numpy().view(np.uint64)
            at = np.repeat(np.arange(len(node)), times)
            line = (node % mine.astype(np.uint64)).astype(np.int64)[at]
            across = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            block = line << 24 | across if cells else across << 24 | line
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), *(batch.column(c).take(pa.array(at)) for c in ("label", "cell", "node", "raw", "weight"))],
                ["block", "label", "cell", "node", "raw", "weight"])
    return work


def links(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """Per row: the key, `n_links`, `component_id`, `kept`."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    rows = durable(rows.withColumn("row", F.xxhash64("id", "label", "v")))
    good = valid(rows.where("label is not null"), "v", every_length=True)
    # From here on a label is a label and a length.
    good = good.withColumn("label", F.concat_ws(":", F.length("raw"), "label")).withColumn("node", F.xxhash64("label", "raw"))
    good = durable(good)
    nodes = durable(good.groupBy("node", "label", "raw").agg(F.count("*").alias("weight")))
    radius = float(np.sqrt(2 - 2 * cosine))

    # Labels with more vectors than a cell should hold get pivots in proportion.
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    large = sizes.orderBy(F.desc("n"), "label").limit(PIVOTS // 2).collect()
    total = sum(r.n for r in large)
    share = {r.label: max(2, min(-(-r.n // CELL), PIVOTS * r.n // (2 * total))) for r in large}
    pivots = {}
    if share:
        wanted = df.sparkSession.createDataFrame(list(share.items()), "label string, wanted long")
        ranked = nodes.join(F.broadcast(wanted), "label").selectExpr(
            "label", "raw", "wanted", "row_number() over (partition by label order by xxhash64(node)) as place")
        for r in ranked.where("place <= wanted").collect():
            pivots.setdefault(r.label, []).append(bytes(r.raw))
        pivots = {name: unit(np.array([np.frombuffer(r) for r in sorted(raws)])) for name, raws in pivots.items()}
    context = df.sparkSession.sparkContext
    sent = context.broadcast(pivots)

    def distances(names, raws):
        """Per row its label's pivots' distances; None for labels without pivots."""
        out = [None] * len(names)
        names = np.array(names, object)
        for name in set(names.tolist()):
            if name in sent.value:
                at = np.flatnonzero(names == name)
                points = unit(matrix(raws.take(pa.array(at))))
                d = np.sqrt(np.maximum(0, 2 - 2 * points @ sent.value[name].T))
                for i, row in zip(at.tolist(), d, strict=True):
                    out[i] = row
        return out

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                d = distances(batch.column("label").to_pylist(), batch.column("raw"))
                cell = [0 if x is None else int(x.argmin()) for x in d]
                far = [0.0 if x is None else float(x.min()) for x in d]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int64()), pa.array(far, pa.float64())], [*batch.schema.names, "cell", "far"])

    base = nodes.select("label", "node", "raw", "weight")
    homes = durable(base.mapInArrow(home, base.select("*").schema.add("cell", "long").add("far", "double")))
    # At most as many rows as there are pivots: labels without pivots are left out.
    reach = {}
    if share:
        farthest = homes.join(F.broadcast(wanted.select("label")), "label").groupBy("label", "cell").agg(F.max("far").alias("far"))
        reach = {(r.label, r.cell): r.far for r in farthest.collect()}
    reached = context.broadcast(reach)

    def copies(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("label").to_pylist()
            d = distances(names, batch.column("raw"))
            at, cell = [], []
            for i, (name, own, x) in enumerate(zip(names, batch.column("cell").to_pylist(), d, strict=True)):
                if x is None:
                    continue
                edge = np.array([reached.value.get((name, c), -np.inf) for c in range(len(x))])
                near = (x <= x[own] + 2 * radius + SLACK) & (x <= edge + radius + SLACK)
                near[own] = False
                for c in np.flatnonzero(near).tolist():
                    at.append(i)
                    cell.append(c)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("label", "node", "raw", "weight")), pa.array(cell, pa.int64())],
                ["label", "node", "raw", "weight", "cell"])

    wide = "label string, node long, raw binary, weight long, cell long"
    everywhere = homes.select("label", "node", "raw", "weight", "cell").union(homes.mapInArrow(copies, wide))
    everywhere = durable(everywhere)
    grid = homes.groupBy("label", "cell").agg(F.count("*").alias("m")).join(
        everywhere.groupBy("label", "cell").agg(F.count("*").alias("a")), ["label", "cell"])
    grid = durable(grid.selectExpr("label", "cell", f"(m + {BLOCK - 1}) div {BLOCK} as down", f"(a + {BLOCK - 1}) div {BLOCK} as over"))
    dealt = "block long, label string, cell long, node long, raw binary, weight long"
    left = homes.select("label", "cell", "node", "raw", "weight").join(grid, ["label", "cell"]).mapInArrow(_dealt(True, "down", "over"), dealt)
    right = everywhere.join(grid, ["label", "cell"]).mapInArrow(_dealt(False, "over", "down"), dealt)

    def compare(members: pa.Table, others: pa.Table) -> pa.Table:
        a, b, n = [], [], []
        if members.num_rows and others.num_rows:
            x, y = matrix(members.column("raw")), matrix(others.column("raw"))
            ux, uy = unit(x), unit(y)
            names = np.concatenate((members.column("node").to_numpy(), others.column("node").to_numpy()))
            # One number per vector, also if it stands on both sides.
            _, place = np.unique(names, return_inverse=True)
            px, py = place[: len(x)], place[len(x) :]
            weight = others.column("weight").to_numpy()
            root = np.arange(place.max() + 1)
            for at in range(0, len(x), 256):
                near = ux[at : at + 256] @ uy.T
                hit = near >= cosine
                for i, j in zip(*np.nonzero(np.abs(near - cosine) < 1e-12), strict=True):
                    p, q = x[at + i], y[j]
                    exact = float(p @ q) / (float(np.sqrt(p @ p)) * float(np.sqrt(q @ q)))
                    hit[i, j] = exact >= cosine if np.isfinite(exact) else hit[i, j]
                for i, row in enumerate(hit):
                    to = np.flatnonzero(row)
                    a.append(int(names[at + i]))
                    b.append(None)
                    n.append(int(weight[to].sum()))
                    seen = np.unique(root[np.append(py[to], px[at + i])])
                    if len(seen) > 1:
                        root[np.isin(root, seen)] = seen[0]
            first = np.zeros(len(root), np.int64)
            first[place] = names
            for i in np.flatnonzero(root != np.arange(len(root))).tolist():
                a.append(int(first[i]))
                b.append(int(first[root[i]]))
                n.append(0)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    found = durable(left.groupBy("label", "cell", "block").cogroup(right.groupBy("label", "cell", "block")).applyInArrow(
        compare, "a long, b long, n long"))
    counted = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null").select("a", "b"))
    lows = good.groupBy("node").agg(F.min("id").alias("low")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    known = lows.join(smallest, "component").join(counted, "node").select("node", "component_id", (F.col("n") - 1).alias("n_links"))
    linked = good.join(known, "node").select("id", "n_links", "component_id")
    alone = rows.join(good.select("row").distinct(), "row", "left_anti").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
