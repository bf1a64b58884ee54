"""Language identification with Bloom filters that answer for all languages at once.

Every slot of the filter holds a bit mask, one bit per language, in as many words of 63
bits as the languages need.  An n-gram's mask is the AND of its slots: the set of languages
that list it, found in `probes` reads whatever the number of languages.  A text's hits per language are the popcounts of
those masks; subtracting what a filter that full reports by chance leaves the
estimate that decides.

Nulls and edges: a null text, or one without a letter, gets `und` and score 0, as
does every text when nothing was learned.  Rows are judged one by one, so repeated
rows get equal answers; ties go to the language that comes first by name.  Other
columns of the input are passed through or ignored, never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import Spans, chunks, mix, texts_of
from chatloom.session import durable

#: Bytes per n-gram, slots of the filter, slots read per n-gram.
GRAM, SLOTS, PROBES = 5, 1 << 20, 3
#: Most rows learned from, and most n-grams listed per language.
TRAIN_ROWS, LISTED = 20_000, 60_000
#: An n-gram is listed for a language if it is seen there this often, and at
#: least this share as likely as in the language that likes it best.
SEEN, SHARE = 3, 0.3
UNKNOWN = "und"
#: Languages in one mask word.
WORD = 63
#: A text with at least `FEW` n-grams is in no learned language if fewer than `LEAST` of the
#: usual share of them is listed.
FEW, LEAST = 20, 0.35

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray  # per word of languages, one mask per slot
    chance: np.ndarray  # per language: how often an unlisted n-gram is reported
    usual: np.ndarray | None = None  # per language: share of its training n-grams that it lists


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and the text each is from."""
    data = _FOLD[data]
    hashes = Spans(data).rolling(GRAM)
    place = np.arange(len(hashes))
    text = np.searchsorted(at, place, side="right") - 1
    inside = place + GRAM <= at[np.minimum(text + 1, len(at) - 1)]
    # An n-gram starts at a letter or at the blank just before one.
    letter = data[: len(hashes)] != 32
    starts = letter | np.append(letter[1:], False)
    good = np.flatnonzero(inside & starts)
    return hashes[good], text[good]


def _slots(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
    bits = np.uint64((slots - 1).bit_length())
    low = np.uint64(slots - 1)
    again = mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    return [((h >> (bits * np.uint64(i))) & low).astype(np.int64) for h, i in
            ((hashes, 0), (hashes, 1), (again, 0), (again, 1))][:PROBES]


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS,
        listed: int = LISTED, slots: int = SLOTS) -> Model:
    """Learn from rows with a language and a text.  Above `train_rows` of them, a
    share of about that many is taken by a hash of the text."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    there = rows.count()
    if there > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * train_rows / there))

    def count(batches):
        for batch in chunks(batches, "text"):
            hashes, of = _grams(*texts_of(batch.column("text")))
            names, code = np.unique(batch.column("lang").to_pylist(), return_inverse=True)
            for i, name in enumerate(names):
                grams, times = np.unique(hashes[code[of] == i], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(times)],
                    ["lang", "gram", "times"])

    seen = rows.mapInArrow(count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    # A table of the n-grams of a bounded sample, read several times below.
    counted = durable(seen)
    whole = counted.groupBy("lang").agg(F.sum("times").alias("whole"))
    seen = counted.where(F.col("times") >= SEEN)
    totals = seen.groupBy("lang").agg(F.sum("times").alias("total"))
    rates = seen.join(F.broadcast(totals), "lang").withColumn("rate", F.col("times") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rates.join(best, "gram").where(F.col("rate") >= SHARE * F.col("best"))
    ranked = kept.selectExpr("lang", "gram", "row_number() over (partition by lang order by rate desc, gram) as place")
    chosen = ranked.where(F.col("place") <= listed).select("lang", "gram")
    table = chosen.toPandas()
    languages = sorted(table["lang"].unique().tolist())
    masks = np.zeros((-(-len(languages) // WORD), slots), np.int64)
    for i, name in enumerate(languages):
        grams = table["gram"][table["lang"] == name].to_numpy(np.int64).view(np.uint64)
        for place in _slots(grams, slots):
            masks[i // WORD, place] |= np.int64(1 << i % WORD)
    filled = np.array([np.count_nonzero(masks[i // WORD] >> i % WORD & 1) for i in range(len(languages))]) / slots
    model = Model(languages, masks, filled ** PROBES)
    # A language's usual rate follows from the counts at hand: occurrences of listed n-grams among all.
    held = seen.join(chosen, ["lang", "gram"]).groupBy("lang").agg(F.sum("times").alias("held"))
    rates = dict(held.join(whole, "lang").select("lang", F.col("held") / F.col("whole")).collect())
    model.usual = np.array([rates.get(name, 0.0) for name in languages])
    return model


def _letters(data: np.ndarray, at: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each text has a letter: ASCII ones are seen in bulk, others asked for."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    sums = np.concatenate(([0], np.cumsum(ascii_letter)))
    has = sums[at[1:]] > sums[at[:-1]]
    for i in np.flatnonzero(~has & (at[1:] > at[:-1])):
        has[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return has


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `lang_pred`, `score`, the winner's share of all corrected hits, `rate`, its
    corrected hits per n-gram of the text, and `fits`: whether that is at least `LEAST` of
    what the language's own texts reach, or the text too short to judge.  Columns that have
    one of these names, in any spelling, are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rate", "fits")]

    def judge(batches):
        m = sent.value
        for batch in chunks(batches, text):
            column = batch.column(text)
            data, at = texts_of(column)
            n = batch.num_rows
            hashes, of = _grams(data, at)
            mask = np.full((len(m.masks), len(hashes)), -1, np.int64)
            for place in _slots(hashes, m.masks.shape[1]):
                mask &= m.masks[:, place]
            total = np.bincount(of, minlength=n).astype(float)
            hits = np.zeros((len(m.languages), n))
            for i in range(len(m.languages)):
                hits[i] = np.bincount(of, weights=mask[i // WORD] >> i % WORD & 1, minlength=n)
            fair = np.maximum(0, (hits - m.chance[:, None] * total) / (1 - m.chance[:, None]))
            known = _letters(data, at, column.fill_null(""))
            if len(m.languages):
                best, whole = fair.argmax(axis=0), fair.sum(axis=0)
                score = np.where(whole > 0, fair.max(axis=0) / np.maximum(whole, 1e-300), 0.0)
                # Letters but no n-gram that any language lists: the first language by name.
                names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                rate = fair.max(axis=0) / np.maximum(total, 1)
                fits = (total < FEW) | (rate >= LEAST * m.usual[best])
            else:
                score, names = np.zeros(n), [UNKNOWN] * n
                rate, fits = np.zeros(n), np.zeros(n, bool)
            score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score, pa.float64()),
                 pa.array(np.where(known, rate, 0.0)), pa.array(fits & known)],
                [*kept, "lang_pred", "score", "rate", "fits"])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rate", "double").add("fits", "boolean")
    return docs.select(*kept).mapInArrow(judge, schema)
