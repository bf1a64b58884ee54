"""Text quality by a factorisation machine.

A text's features are its hashed words, each of weight 1 / sqrt(number of different
ones), and the buckets of structure statistics (shares of letter classes and marks,
word and line lengths, repeats) and of metadata (how a declared length compares with
the real one).  The score is the logistic of

    bias + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

whose second sum equals all pairwise interactions and takes linear time.

Fitting takes at most `TRAIN_ROWS` labelled rows, chosen by a hash, to the driver;
scoring runs over any number of rows with a model of fixed size.

Nulls and edges: a null text counts as empty and is scored by its statistics; a null
declared length has a bucket of its own; rows without a label are not learned from.
With no labelled row every score is 0.5.  Rows are scored one by one, so repeated
rows get equal scores; other columns are passed through unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import Spans, chunks, texts_of

WORDS, RANK, BUCKETS = 1 << 16, 8, 12
TRAIN_ROWS, EPOCHS, BATCH, RATE, DECAY = 12_000, 8, 256, 0.05, 2e-5

_CLASS = np.full(256, 8, np.uint8)  # other marks
for _i in range(256):
    _c = chr(_i)
    if _i >= 128:
        _CLASS[_i] = 0
    elif _c.isupper():
        _CLASS[_i] = 1
    elif _c.islower():
        _CLASS[_i] = 2
    elif _c.isdigit():
        _CLASS[_i] = 3
    elif _c == "\n":
        _CLASS[_i] = 4
    elif _c.isspace():
        _CLASS[_i] = 5
    elif _c in ".,;:'\"-()":
        _CLASS[_i] = 6
    elif _c in "!?|":
        _CLASS[_i] = 7
_CLASSES = 9
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
STATS = _CLASSES + 10


def _runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross a text's border: start, end, text."""
    change = np.zeros(len(inside) + 1, np.int8)
    change[:-1] += inside
    change[1:] -= inside
    start = np.flatnonzero(change == 1)
    border = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(inside))]
    border = np.unique(border)
    border = border[inside[border] & inside[border - 1]] if len(border) else border
    start = np.sort(np.concatenate((start, border)))
    end = np.sort(np.concatenate((np.flatnonzero(change == -1), border)))
    return start, end, np.searchsorted(at, start, side="right") - 1


def features(data: np.ndarray, at: np.ndarray, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word feature, its slot, statistics per text)."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    low = _LOWER[data]
    spans = Spans(low)
    start, end, text = _runs(~_BLANK[data], at)
    words = spans.hash(start, end)
    count = np.bincount(text, minlength=n).astype(float)
    pairs = np.unique(text.astype(np.uint64) << np.uint64(16) | words >> np.uint64(48))
    of, slot = (pairs >> np.uint64(16)).astype(np.int64), (pairs & np.uint64(0xFFFF)).astype(np.int64)
    distinct = np.bincount(of, minlength=n).astype(float)
    same = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    lstart, lend, ltext = _runs(data != 10, at)
    lines = np.bincount(ltext, minlength=n).astype(float)
    lpairs = np.unique(ltext.astype(np.uint64) << np.uint64(40) | spans.hash(lstart, lend) >> np.uint64(24))
    unlike = np.bincount((lpairs >> np.uint64(40)).astype(np.int64), minlength=n)
    # Words that end in a mark other than the usual ones.
    odd = np.isin(_CLASS[data[end - 1]], (7, 8)) if len(end) else np.zeros(0, bool)
    out = np.zeros((n, STATS))
    sums = np.zeros(len(data) + 1, np.int64)
    for c in range(_CLASSES):
        np.cumsum(_CLASS[data] == c, out=sums[1:])
        out[:, c] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(size, 1)
    letters = np.maximum(count, 1)
    characters = size - np.concatenate(([0], np.cumsum(data & 0xC0 == 0x80)))[at[1:]] + np.concatenate(([0], np.cumsum(data & 0xC0 == 0x80)))[at[:-1]]
    extra = (
        np.log1p(size), np.log1p(count), np.bincount(text, weights=end - start, minlength=n) / letters,
        distinct / letters, np.bincount(text[1:], weights=same, minlength=n) / letters,
        np.log1p(lines), unlike / np.maximum(lines, 1), count / np.maximum(lines, 1),
        np.bincount(text, weights=odd, minlength=n) / letters,
        np.where(np.isnan(declared), -1.0, (declared + 1) / (characters + 1)),
    )
    for i, values in enumerate(extra):
        out[:, _CLASSES + i] = values
    return of, slot, out


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray
    cuts: np.ndarray  # per statistic the borders of its buckets

    def inputs(self, of, slot, stats):
        """The features of all texts in text order: (first of each text, slots, weights)."""
        n = len(stats)
        words = np.bincount(of, minlength=n)
        bucket = np.stack([np.searchsorted(self.cuts[j], stats[:, j]) for j in range(STATS)], axis=1)
        places = WORDS + np.arange(STATS) * (BUCKETS + 1) + bucket
        first = np.concatenate(([0], np.cumsum(words + STATS)))
        slots = np.zeros(first[-1], np.int64)
        x = np.ones(first[-1])
        stat_at = first[:-1, None] + np.arange(STATS)
        slots[stat_at] = places
        word_at = np.ones(first[-1], bool)
        word_at[stat_at.ravel()] = False
        slots[word_at] = slot
        x[word_at] = (1 / np.sqrt(np.maximum(words, 1)))[of]
        return first, slots, x

    def margins(self, first, slots, x):
        begin = first[:-1]
        vx = self.v[slots] * x[:, None]
        sums = np.add.reduceat(vx, begin, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), begin)
        return self.bias + np.add.reduceat(self.w[slots] * x, begin) + 0.5 * ((sums * sums).sum(axis=1) - squares), vx, sums


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: DataFrame, label: str, text: str = "text", declared: str | None = None, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows with a 0/1 label; the caller has bounded their number."""
    columns = [F.col(text).alias("text"), F.col(label).cast("double").alias("y"),
               (F.col(declared) if declared else F.lit(None)).cast("double").alias("declared")]

    def gather(batches):
        for batch in chunks(batches, "text"):
            y = batch.column("y").to_numpy(zero_copy_only=False)
            said = batch.column("declared").to_numpy(zero_copy_only=False).astype(float)
            of, slot, stats = features(*texts_of(batch.column("text")), said)
            bound = np.searchsorted(of, np.arange(len(y) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(y), pa.array([slot[a:b].astype(np.uint16).tobytes() for a, b in zip(bound, bound[1:], strict=False)], pa.binary()),
                 pa.array([s.tobytes() for s in stats], pa.binary())], ["y", "slots", "stats"])

    got = rows.where(F.col(label).isNotNull()).select(*columns).mapInArrow(gather, "y double, slots binary, stats binary").collect()
    got = sorted(got[:train_rows], key=lambda r: (r.y, bytes(r.stats), bytes(r.slots)))
    size = WORDS + STATS * (BUCKETS + 1)
    model = Model(0.0, np.zeros(size), np.zeros((size, RANK)), np.zeros((STATS, BUCKETS)))
    if not got:
        return model
    rng = np.random.default_rng(7)
    got = [got[i] for i in rng.permutation(len(got))]
    y = np.array([r.y for r in got])
    stats = np.stack([np.frombuffer(r.stats) for r in got])
    slot = [np.frombuffer(r.slots, np.uint16).astype(np.int64) for r in got]
    of = np.repeat(np.arange(len(got)), [len(s) for s in slot])
    model.cuts = np.quantile(stats, np.linspace(0, 1, BUCKETS + 2)[1:-1], axis=0).T.copy()
    first, slots, x = model.inputs(of, np.concatenate(slot), stats)
    model.v = rng.normal(0, 0.02, (size, RANK))
    share = np.clip(y.mean(), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v = np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(EPOCHS):
        for a in range(0, len(y), BATCH):
            b = min(a + BATCH, len(y))
            inside = slice(first[a], first[b])
            begin, s, xs = first[a : b + 1] - first[a], slots[inside], x[inside]
            z, vx, sums = model.margins(begin, s, xs)
            g = (_logistic(z) - y[a:b]) / (b - a)
            row = np.repeat(np.arange(b - a), np.diff(begin))
            gx = g[row] * xs
            order = np.argsort(s, kind="stable")
            which, start = np.unique(s[order], return_index=True)
            dw = np.add.reduceat(gx[order], start) + DECAY * model.w[which]
            dv = np.add.reduceat((gx[:, None] * (sums[row] - vx))[order], start, axis=0) + DECAY * model.v[which]
            seen_w[which] += dw * dw
            seen_v[which] += dv * dv
            model.w[which] -= RATE * dw / np.sqrt(seen_w[which])
            model.v[which] -= RATE * dv / np.sqrt(seen_v[which])
            model.bias -= RATE * float(g.sum())
    return model


def choose(labels: DataFrame, key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """At most about `train_rows` labelled rows, by a hash of their key."""
    there = labels.count()
    if there <= train_rows:
        return labels
    return labels.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * train_rows / there))


def score(docs: DataFrame, model: Model, text: str = "text", declared: str | None = None) -> DataFrame:
    """The rows without their text, with `score` and `predicted`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text and c not in ("score", "predicted")]

    def judge(batches):
        m = sent.value
        for batch in chunks(batches, text):
            said = (batch.column(declared).to_numpy(zero_copy_only=False).astype(float) if declared
                    else np.full(batch.num_rows, np.nan))
            p = _logistic(m.margins(*m.inputs(*features(*texts_of(batch.column(text)), said)))[0])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                [*kept, "score", "predicted"])

    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*kept, text).mapInArrow(judge, schema)
