"""Keyword retrieval for a table of queries at once.

queries: query_id, text, intent, keywords, date_from, date_to, chat_id.

A keyword is a phrase whose last word may be a prefix.  The collection is cut into words
once and stored.  Its vocabulary, far smaller than its text, meets the asked prefixes; what
comes out says for each term which prefixes it completes.  Only positions that hold such a
term go on, each with as many words before it as the phrase has, and these runs meet the
phrases by equality: no document meets a phrase it does not contain, and work grows with
matches, not with queries times words."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import constants as K
from chatloom.functions import text as T
from chatloom.operators.ordered import Ordered
from chatloom.operators.often import bit_filter, frequent, may_hold
from chatloom.operators.ranges import messages_in_sessions
from chatloom.session import SENT_BYTES, durable, sent, spread, tasks_for

# Scores are sums of floats, whose last bits depend on the order of addition; ranking
# looks at the digits that do not.
SCORE_DIGITS = 12
MESSAGE_KEY = ["chat_id", "timestamp", "line_number"]


# --- documents and phrases ---------------------------------------------------

def tokenized(docs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, tokens (one array per field) and the document length.  This is what
    to store when the same documents are searched often."""
    tokens = F.array(*[T.search_tokens(F.coalesce(f, F.lit(""))) for f in fields])
    return spread(docs.select(*dict.fromkeys([*keys, *fields]))).select(*keys, tokens.alias("tokens")).withColumn(
        "doc_length", F.size(F.flatten("tokens")).cast("long")
    )


def vocabulary(docs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """term, documents it occurs in, occurrences.  Counting inside the document
    first keeps frequent terms from being shuffled once per occurrence."""
    tokens = tokenized(docs, keys, fields).select(*keys, F.explode(F.flatten("tokens")).alias("term"))
    per_doc = tokens.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("tf").alias("occurrences")
    )


def phrases(queries: DataFrame, keep_spaces: bool = True) -> DataFrame:
    """query_id, keyword number, phrase, its last word and number of words."""
    words = queries.select(
        "query_id", F.posexplode(T.clean_keywords(F.col("keywords"), keep_spaces)).alias("kw_no", "kw")
    ).withColumn("__w", T.search_tokens(F.col("kw")))
    return words.filter(F.size("__w") > 0).select(
        "query_id", "kw_no",
        F.array_join("__w", " ").alias("phrase"),
        F.element_at("__w", -1).alias("last"),
        F.size("__w").alias("words"),
    )


def completions(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """term, last, words: the asked prefixes that each term completes.  terms: term;
    asked: last, words.  Every term is cut to the few lengths that prefixes have, so
    prefixes and vocabulary meet by equality."""
    lengths = asked.agg(F.collect_set(F.length("last")).alias("l")).scalar()
    fitting = F.filter("__l", lambda n: n <= F.length("term"))
    cut = terms.withColumn("__l", lengths).withColumn("__l", F.explode(fitting))
    return cut.select("term", F.substr(F.col("term"), F.lit(1), F.col("__l")).alias("last")).join(asked, "last")


def phrase_hits(docs: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """query_id, kw_no, keys, doc_length, tf: how often each phrase is in a document.
    `docs` comes from `tokenized` and should be stored, as it is read twice."""
    asked = wanted.select("last", "words").distinct()
    terms = docs.select(F.explode(F.flatten("tokens")).alias("term")).distinct()
    # Stored, because its size decides how it meets the positions.
    matching = durable(completions(terms, asked))
    size = matching.agg(F.sum(F.octet_length("term") + F.octet_length("last") + 32), F.max("words")).first()
    fields = docs.select(*keys, "doc_length", F.explode("tokens").alias("__w"))
    placed = fields.select("*", F.posexplode("__w").alias("__pos", "term"))
    behind = lambda words, many: F.slice(
        words, F.greatest(F.col("__pos") - many + 2, F.lit(1)), F.least(F.col("__pos"), many - 1))
    if (size[0] or 0) <= SENT_BYTES:
        # Positions stay where they are; the words before are taken where the term matches.
        found = placed.join(F.broadcast(matching), "term").withColumn("__before", behind(F.col("__w"), F.col("words")))
    else:
        narrow = placed.withColumn("__w", behind(F.col("__w"), F.lit(size[1])))
        last_of = F.slice("__w", F.greatest(F.size("__w") - F.col("words") + 2, F.lit(1)), F.col("words") - 1)
        # Said, because stored documents are estimated as what they were read from, and would
        # be sent to the few tasks of the terms.
        found = narrow.join(matching.hint("merge"), "term").withColumn("__before", last_of)
    whole = found.filter(F.size("__before") == F.col("words") - 1)
    phrase = F.when(F.col("words") == 1, F.col("last")).otherwise(F.concat(F.array_join("__before", " "), F.lit(" "), F.col("last")))
    runs = whole.select(*keys, "doc_length", phrase.alias("phrase"))
    if (size[1] or 0) > 1:
        # Most runs of several words are no phrase of any query.
        runs = _asked_for(runs, wanted.select("phrase"))
    return (
        runs.join(wanted.select("query_id", "kw_no", "phrase"), "phrase")
        .groupBy("query_id", "kw_no", *keys, "doc_length")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


# Slots (bits) of the filter of phrases for one of them, and at most.
SLOTS_EACH, MOST_SLOTS = 16, 1 << 26


def _asked_for(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """`runs` without nearly all whose phrase is not among the asked ones, before they are
    shuffled to meet them."""
    n = asked.count()
    bits = 16 + (SLOTS_EACH * n).bit_length()
    slots = min(MOST_SLOTS, 1 << bits - 16 if n > 64 else 1 << 10)
    number = F.xxhash64("phrase").bitwiseAND(F.lit((1 << bits) - 1))
    lists, inner = frequent(asked.select(number.alias("h")), bits, 1, n)
    passed = durable(bit_filter(lists, bits, inner, slots)).scalar()
    return runs.filter(may_hold(passed, number, bits, slots))


def bm25(docs: DataFrame, keys: list[str], wanted: DataFrame, most: int | None = None) -> DataFrame:
    """query_id, keys, score of every document with at least one phrase.  With `most`, only
    of each query's first ones by falling score, then keys; many queries then share what
    they have in common."""
    if most is not None:
        return _first_by_bm25(docs, keys, wanted, most)
    docs = durable(docs)
    return (
        _weighted(docs, keys, wanted).groupBy("query_id", *keys)
        .agg(F.round(F.sum("__s"), SCORE_DIGITS).alias("score"))
    )


def _weighted(docs: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """What each phrase of a query adds to the score of a document that has it, `__s`."""
    hits = phrase_hits(docs, keys, wanted)
    # Asking for tf keeps both uses of the hits alike, so Spark computes them once.
    found_in = hits.groupBy("query_id", "kw_no").agg(F.count_if(F.col("tf") > 0).alias("df"))
    # One row with the collection's totals.
    totals = docs.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("doc_length").alias("words")).alias("t")
    ).scalar()
    scored = hits.join(found_in, ["query_id", "kw_no"]).withColumn("__t", totals)
    n, df, tf = F.col("__t.n"), F.col("df"), F.col("tf")
    idf = F.greatest(F.lit(K.BM25_IDF_FLOOR), F.log((n - df + 0.5) / (df + 0.5)))
    relative = F.col("doc_length") * n / F.col("__t.words")
    weight = tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * relative))
    return scored.withColumn("__s", idf * weight)


def _first_by_bm25(docs: DataFrame, keys: list[str], wanted: DataFrame, most: int) -> DataFrame:
    """query_id, keys, score of each query's first `most` documents.

    Queries are cut into parts (a keyword and how often it is asked), equal parts are matched
    once and queries of equal parts ranked once.  A document that has one part only is among
    the first just if it is among that part's.  Any other has a part besides the query's most
    frequent one: the rarer parts' documents are looked at, a slice of all documents at a time."""
    by_no = wanted.filter("query_id IS NOT NULL").groupBy("query_id", "kw_no").agg(
        F.array_join(F.array_sort(F.collect_list("phrase")), "|").alias("term"))
    by_term = by_no.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    # Phrases hold letters, digits and spaces only, so the joined texts tell parts apart.
    part = F.concat(F.col("n").cast("string"), F.lit(":"), F.col("term"))
    texts = durable(by_term.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(part)), "\n").alias("text")))
    # From here on questions, parts and documents are numbers; their texts are not shuffled.
    questions = _with_number(texts.select("text").distinct(), "question")
    asked = texts.join(questions, "text").select("query_id", "question")
    cut = durable(questions.select("question", F.explode(F.split("text", "\n")).alias("text")))
    once = _with_number(cut.select("text").distinct(), "part")
    parts = durable(cut.join(once, "text").select("question", "part"))
    phrase = F.explode(F.split(F.substring_index("text", ":", -1), "\\|")).alias("phrase")
    words = F.split("phrase", " ")
    # How often a part is asked stands where the keyword's number does.
    listed = once.select(F.col("part").alias("query_id"), F.substring_index("text", ":", 1).cast("int").alias("kw_no"), phrase).select(
        "*", F.element_at(words, -1).alias("last"), F.size(words).alias("words"))
    docs = numbered(docs, keys)
    scored = durable(_weighted(docs.drop(*keys), ["__d"], listed).groupBy(F.col("query_id").alias("part"), "__d").agg(
        F.sum(F.col("__s") * F.col("kw_no")).alias("__s")))
    rounded = lambda c: F.round(c, SCORE_DIGITS)
    first = durable(top_k(scored, ["part"], [F.desc(rounded(F.col("__s"))), "__d"], most, "__at"))
    # Parts that no document has are left out.
    known = durable(parts.join(first.select("part").distinct(), "part").withColumn(
        "__n", F.count(F.lit(1)).over(Window.partitionBy("question"))))
    alone = known.filter("__n = 1").join(first, "part").select("question", "__d", "__s")
    several = durable(known.filter("__n > 1").select("question", "part"))
    together = _in_slices(scored, several, most)
    total = alone.unionByName(together).select("question", "__d", rounded(F.col("__s")).alias("score"))
    best = top_k(total, ["question"], [F.desc("score"), "__d"], most, "__at").drop("__at")
    named = best.join(docs.select("__d", *keys).distinct(), "__d")
    return asked.join(named, "question").select("query_id", *keys, "score")


# Scores of documents, and parts of questions, that a task holds at once.
SLICE_SCORES, SLICE_PARTS = 4_000_000, 1_000_000


def _in_slices(scored: DataFrame, several: DataFrame, most: int) -> DataFrame:
    """question, __d, __s: candidates for the first `most` documents of questions with several
    parts.  scored: part, __d, __s; several: question, part.

    A slice of the documents has all their scores and gives its own first `most` documents of
    each question: no document is shuffled for each question it fits."""
    needed = scored.join(sent(durable(several.select("part").distinct())), "part", "left_semi")
    slices, blocks = max(1, -(-scored.count() // SLICE_SCORES)), max(1, -(-several.count() // SLICE_PARTS))
    slice_of, block_of = F.pmod(F.xxhash64("__d"), F.lit(slices)), F.pmod(F.xxhash64("question"), F.lit(blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = needed.select("part", "__d", "__s", slice_of.alias("__slice"), each(blocks).alias("__block"))
    right = several.select("question", "part", each(slices).alias("__slice"), block_of.alias("__block"))
    cells = left.groupBy("__slice", "__block").cogroup(right.groupBy("__slice", "__block"))
    return cells.applyInArrow(lambda scores, asked: _first_of_slice(scores, asked, most), "question long, __d long, __s double")


def _first_of_slice(scores: pa.Table, asked: pa.Table, most: int) -> pa.Table:
    part, d, s = (scores.column(c).to_numpy() for c in ("part", "__d", "__s"))
    order = np.lexsort((d, part))
    part, d, s = part[order], d[order], s[order]
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    postings = {int(part[lo]): (d[lo:hi], s[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])}
    leading = {}
    question, wanted = (asked.column(c).to_numpy() for c in ("question", "part"))
    order = np.argsort(question, kind="stable")
    question, wanted = question[order], wanted[order]
    cuts = np.append(np.flatnonzero(np.diff(question, prepend=-1)), len(question))
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        had = [p for p in wanted[lo:hi].tolist() if p in postings]
        if not had:
            continue
        # A document that has the most frequent part only is among that part's first ones.
        top = max(had, key=lambda p: len(postings[p][0]))
        if top not in leading:
            leading[top] = postings[top][0][_leading(*postings[top], most)]
        met = np.unique(np.concatenate([leading[top], *(postings[p][0] for p in had if p != top)]))
        total = np.zeros(len(met))
        for p in had:
            at = np.minimum(np.searchsorted(postings[p][0], met), len(postings[p][0]) - 1)
            total += np.where(postings[p][0][at] == met, postings[p][1][at], 0.0)
        kept = _leading(met, total, most)
        out.append((np.full(len(kept), question[lo]), met[kept], total[kept]))
    columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(dict(zip(["question", "__d", "__s"], columns)))


def _leading(d: np.ndarray, s: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` by falling score, rounded as the engine does, then number."""
    if len(s) <= most:
        return np.arange(len(s))
    near = np.flatnonzero(s >= np.partition(s, len(s) - most)[len(s) - most] - 1e-9)
    values, which = np.unique(s[near], return_inverse=True)
    unit = Decimal(1).scaleb(-SCORE_DIGITS)
    rounded = np.array([float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in values.tolist()])[which]
    return near[np.lexsort((d[near], -rounded))[:most]]


def _with_number(rows: DataFrame, name: str) -> DataFrame:
    """The rows, stored, each with a number of its own."""
    return durable(rows.withColumn(name, F.monotonically_increasing_id()))


def numbered(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The documents, stored, with a number `__d` that is in the order of the keys and the
    same where they are."""
    at = docs.repartitionByRange(tasks_for(docs), *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    return durable(at.withColumn("__d", F.min("__at").over(Window.partitionBy(*keys))).drop("__at"))


def top_k(df: DataFrame, group: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group.  Spark limits each partition to k rows per
    group before shuffling, so a huge group never meets in one task."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, number).filter(F.col(name) <= k)


def within_dates(df: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Keep rows inside the query's optional bounds; 0 or null is no bound."""
    low = F.coalesce("date_from", F.lit(0))
    high = F.coalesce("date_to", F.lit(0))
    return df.filter(((low == 0) | (F.col(start) >= low)) & ((high == 0) | (F.col(end) <= high)))


def _bounds(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "date_from", "date_to", F.col("chat_id").alias("only_chat"))


# --- messages ----------------------------------------------------------------

def factual_pivots(
    queries: DataFrame, messages: DataFrame, limit: int = K.FACTUAL_PIVOTS, bounded: bool = False
) -> DataFrame:
    """Best messages per query.  With `bounded`, the query's dates and chat also
    restrict them."""
    docs = tokenized(messages, MESSAGE_KEY, ["sender", "content"])
    # Without bounds only each query's first ones are needed, and equal keywords meet once.
    scored = bm25(docs, MESSAGE_KEY, phrases(queries), None if bounded else limit)
    if bounded:
        scored = within_dates(scored.join(_bounds(queries), "query_id"), "timestamp", "timestamp").filter(
            F.col("only_chat").isNull() | (F.col("only_chat") == F.col("chat_id"))
        ).select("query_id", *MESSAGE_KEY, "score")
    return top_k(scored, ["query_id"], [F.desc("score"), *MESSAGE_KEY], limit)


def search_factual(
    queries: DataFrame, messages: DataFrame, window: int = K.FACTUAL_WINDOW,
    limit: int = K.FACTUAL_PIVOTS, bounded: bool = False,
) -> DataFrame:
    """Rows (query_id, rank, score, pos, message columns) around each pivot."""
    pivots = factual_pivots(queries, messages, limit, bounded)
    # Only chats with a pivot are put in order.
    near = messages.join(pivots.select("chat_id").distinct(), "chat_id", "left_semi")
    placed = Ordered.over(near, ["chat_id"], ["timestamp", "line_number"]).row_number("pos").result()
    minute = placed.groupBy("chat_id", "timestamp").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    before = F.sequence(F.greatest(F.lit(1), F.col("hi") - window), F.col("hi"))
    after = F.sequence(F.col("lo"), F.col("lo") + window)
    wanted = (
        pivots.join(minute, ["chat_id", "timestamp"])
        .select("query_id", "rank", "score", "chat_id", F.explode(F.array_union(before, after)).alias("pos"))
    )
    return wanted.join(placed, ["chat_id", "pos"])


def factual_blocks(windows: DataFrame) -> DataFrame:
    """One text block per pivot; a window has a few dozen messages at most."""
    line = F.concat(
        F.lit("["), T.clock(F.col("timestamp")), F.lit("] "), F.col("sender"), F.lit(": "), F.col("content")
    )
    item = F.struct("pos", "timestamp", "sender", line.alias("line"))
    grouped = windows.groupBy("query_id", "rank", "chat_id").agg(
        F.array_sort(F.collect_list(item)).alias("__w")
    )
    return grouped.select(
        "query_id", "rank", "chat_id",
        F.element_at("__w", 1)["timestamp"].alias("start_time"),
        F.element_at("__w", 1)["sender"].alias("sender"),
        F.size("__w").cast("long").alias("messages"),
        T.js_trim(F.array_join(F.transform("__w", lambda x: x["line"]), "\n")).alias("content"),
    )


def neighbours(
    requests: DataFrame, sessions: DataFrame, messages: DataFrame, limit: int = K.NEIGHBOUR_LIMIT
) -> DataFrame:
    """Messages around the first one of a session that contains a snippet, or the
    start of the session when none does.  requests: request_id, session_id, snippet."""
    spans = requests.join(sessions.select(F.col("id").alias("session_id"), "chat_id", "start_time", "end_time"), "session_id")
    rows = messages_in_sessions(messages, spans.select("request_id", "snippet", "chat_id", "start_time", "end_time"))
    rows = rows.withColumnsRenamed({"session_request_id": "request_id", "session_snippet": "snippet"})
    at = F.struct("timestamp", "line_number")
    hit = F.contains(F.lower("content"), F.lower("snippet"))
    pivots = rows.filter(hit).groupBy("request_id").agg(F.min(at).alias("pivot"))
    told = rows.join(pivots, "request_id", "left")
    kind = (
        F.when(F.col("pivot").isNull(), "opening")
        .when(F.col("timestamp") < F.col("pivot.timestamp"), "before")
        .when(F.col("timestamp") > F.col("pivot.timestamp"), "after")
        .when(F.col("line_number") == F.col("pivot.line_number"), "pivot")
    )
    told = told.withColumn("kind", kind).filter("kind is not null")
    back = F.col("kind") == "before"
    nearest = [
        F.when(back, -F.col("timestamp")).otherwise(F.col("timestamp")),
        F.when(back, -F.col("line_number")).otherwise(F.col("line_number")),
    ]
    kept = top_k(told, ["request_id", "kind"], nearest, 2 * limit, "__n")
    return kept.filter((F.col("kind") == "opening") | (F.col("__n") <= limit)).select(
        "request_id", "kind", "chat_id", "timestamp", "line_number", "sender", "content"
    )


# --- sessions and entities ---------------------------------------------------

def is_recent(queries: DataFrame) -> Column:
    return F.array_contains("keywords", K.RECENT_MARK)


def search_recent(queries: DataFrame, sessions: DataFrame, limit: int = K.NARRATIVE_LIMIT) -> DataFrame:
    """Latest sessions inside each query's dates; rank 1 is the oldest of them.

    Queries are few kinds of date bounds: sessions are compared with each
    distinct pair of bounds once, not with each query."""
    asked = queries.filter(is_recent(queries)).select(
        "query_id", F.coalesce("date_from", F.lit(0)).alias("date_from"),
        F.coalesce("date_to", F.lit(0)).alias("date_to"),
    )
    bounds = asked.select("date_from", "date_to").distinct()
    ranges = bounds.agg(F.collect_set(F.struct("date_from", "date_to")).alias("b")).scalar()
    inside = F.filter(
        "__b",
        lambda b: ((b["date_from"] == 0) | (F.col("start_time") >= b["date_from"]))
        & ((b["date_to"] == 0) | (F.col("end_time") <= b["date_to"])),
    )
    rows = sessions.withColumn("__b", ranges).withColumn("__b", F.explode(inside))
    rows = rows.select(*sessions.columns, "__b.date_from", "__b.date_to")
    latest = top_k(rows, ["date_from", "date_to"], [F.desc("start_time"), F.desc("id")], limit, "__n")
    oldest_first = Window.partitionBy("date_from", "date_to").orderBy(F.desc("__n"))
    latest = latest.withColumn("rank", F.row_number().over(oldest_first)).drop("__n")
    return asked.join(latest, ["date_from", "date_to"]).drop("date_from", "date_to")


def search_narrative(
    queries: DataFrame, sessions: DataFrame, limit: int = K.NARRATIVE_LIMIT, keep_spaces: bool = False
) -> DataFrame:
    """Sessions by relevance of their summary: query_id, rank, score, session columns."""
    asked = queries.filter(~is_recent(queries))
    docs = tokenized(sessions, ["id"], ["summary"])
    scored = bm25(docs, ["id"], phrases(asked, keep_spaces))
    rows = within_dates(scored.join(sessions, "id").join(_bounds(asked), "query_id"))
    ranked = top_k(rows, ["query_id"], [F.desc("score"), "id"], limit)
    return ranked.drop("date_from", "date_to", "only_chat")


ENTITY_TEXT = ["name", "normalized_name", "type", "action"]


def entity_texts(entities: DataFrame) -> DataFrame:
    """The different texts of entities, cut into words and stored: the same few (name, type,
    action) recur, and each is matched once."""
    texts = entities.select(*ENTITY_TEXT).distinct().withColumn("__type", F.col("type"))
    return durable(tokenized(texts, ENTITY_TEXT, ["name", "__type", "action"]))


def search_aggregation(
    queries: DataFrame, entities: DataFrame, sessions: DataFrame, limit: int = K.AGGREGATION_LIMIT, texts: DataFrame | None = None,
) -> DataFrame:
    """Entities counted by (normalized_name, type): query_id, rank, name, type, count.
    `texts` comes from `entity_texts`, if several searches share it."""
    text = ENTITY_TEXT
    docs = entity_texts(entities) if texts is None else texts
    matched = durable(phrase_hits(docs, text, phrases(queries)).select("query_id", *text).distinct())
    texts = _with_number(matched.select(*text).distinct(), "__text")
    dated = queries.select("query_id", "date_from", "date_to")
    asked = durable(matched.join(texts, text).join(dated, "query_id").select(
        "query_id", "date_from", "date_to", "__text", F.col("normalized_name").alias("name"), "type"))
    # An entity meets its session once, as a number, and then the queries that its text is for.
    hits = entities.select("session_id", *text).join(sent(texts), text).select("session_id", "__text")
    rows = hits.join(
        sessions.select(F.col("id").alias("session_id"), "start_time", "end_time"), "session_id"
    ).select("__text", "start_time", "end_time")
    counted = (
        within_dates(rows.join(sent(asked), "__text"))
        .groupBy("query_id", "name", "type")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return top_k(counted, ["query_id"], [F.desc("count"), "name", "type"], limit)


def entity_hop(
    queries: DataFrame, entities: DataFrame, sessions: DataFrame, limit: int = K.HOP_LIMIT, texts: DataFrame | None = None
) -> DataFrame:
    """Queries whose keywords gained the names of the entities they point at."""
    names = search_aggregation(queries, entities, sessions, limit, texts).groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]
        ).alias("__names")
    )
    return (
        queries.join(names, "query_id", "left")
        .withColumn("keywords", T.union_keywords(F.col("keywords"), F.col("__names")))
        .drop("__names")
    )


def routed_search(
    queries: DataFrame, messages: DataFrame, sessions: DataFrame, entities: DataFrame,
    chats: DataFrame, bounded: bool = False, hop: bool = True,
) -> DataFrame:
    """Each query by its intent, all in one result table."""
    asked = queries.withColumn("keywords", T.keywords_or_text(F.col("keywords"), F.col("text")))
    texts = entity_texts(entities)
    if hop:
        # The hop searches all entities; its result is only as long as the query
        # table and feeds every branch below.
        asked = durable(entity_hop(asked, entities, sessions, texts=texts))
    intent = F.col("intent")
    counts = search_aggregation(asked.filter(intent == "aggregation"), entities, sessions, texts=texts)
    item = F.concat(
        F.lit("- Entity: "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(") | Count: "),
        F.col("count").cast("string"), F.lit("\n"),
    )
    aggregation = counts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("__i")
    ).select(
        "query_id", F.lit(1).alias("rank"), F.lit("aggregation").alias("kind"),
        F.lit("").alias("chat_id"), F.lit(K.AGGREGATION_CHAT).alias("chat_name"), F.lit(1.0).alias("score"),
        F.lit(None).cast("long").alias("start_time"), F.lit("System").alias("sender"),
        F.concat(
            F.lit(K.AGGREGATION_HEADER + "\n"), F.array_join(F.transform("__i", lambda x: x["item"]), "")
        ).alias("content"),
    )
    told = asked.filter(intent == "narrative")
    session_columns = ["query_id", "rank", "chat_id", "start_time", "summary"]
    narrative = search_narrative(told, sessions).select(session_columns).unionByName(
        search_recent(told, sessions).select(session_columns)
    ).select(
        "query_id", "rank", F.lit("narrative").alias("kind"), "chat_id",
        F.lit(0.9).alias("score"), "start_time", F.lit("System").alias("sender"),
        F.concat(F.lit(K.NARRATIVE_HEADER + "\n"), "summary").alias("content"),
    )
    fact = asked.filter(~intent.isin("aggregation", "narrative"))
    factual = factual_blocks(search_factual(fact, messages, bounded=bounded)).select(
        "query_id", "rank", F.lit("factual").alias("kind"), "chat_id",
        F.lit(1.0).alias("score"), "start_time", "sender", "content",
    )
    named = (
        narrative.unionByName(factual)
        .join(chats.select(F.col("id").alias("chat_id"), F.col("name").alias("chat_name")), "chat_id", "left")
        .withColumn("chat_name", F.coalesce("chat_name", F.lit(K.UNKNOWN_CHAT)))
    )
    return named.unionByName(aggregation)


# --- aliases, suggestions, rendering ------------------------------------------

def match_aliases(
    asked: DataFrame, aliases: DataFrame, people: DataFrame, limit: int = K.ALIAS_LIMIT
) -> DataFrame:
    """People whose alias starts with the asked one.  asked: query_id, alias."""
    wanted = phrases(asked.select("query_id", F.array("alias").alias("keywords")))
    docs = tokenized(aliases, ["person_id", "alias"], ["alias"])
    scored = bm25(docs, ["person_id", "alias"], wanted)
    ranked = top_k(scored, ["query_id"], [F.desc("score"), "person_id", "alias"], limit)
    return ranked.join(people.select(F.col("id").alias("person_id"), "name"), "person_id")


def suggest(prefixes: DataFrame, terms: DataFrame, limit: int = 5) -> DataFrame:
    """Most frequent terms per prefix.  prefixes: prefix; terms: term, occurrences."""
    wanted = prefixes.select(T.fold(F.col("prefix")).alias("prefix")).filter("prefix <> ''").distinct()
    lengths = wanted.agg(F.collect_set(F.length("prefix")).alias("l")).scalar()
    fitting = F.filter("__l", lambda n: n <= F.length("term"))
    cut = (
        terms.withColumn("__l", lengths)
        .withColumn("__l", F.explode(fitting))
        .withColumn("prefix", F.substr(F.col("term"), F.lit(1), F.col("__l")))
        .drop("__l")
    )
    return top_k(cut.join(wanted, "prefix"), ["prefix"], [F.desc("occurrences"), "term"], limit)


def snippet_lines(blocks: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Lines of a display text: sender (first word), time and text; a line that
    does not open a message continues the one before."""
    shape = K.SNIPPET_LINE
    lines = blocks.select(*keys, F.posexplode(F.split(content, "\n")).alias("line_no", "line"))
    opens = F.col("line").rlike(shape)
    part = lambda n: F.regexp_extract("line", shape, n)
    return lines.select(
        *keys, F.col("line_no").cast("long").alias("line_no"),
        F.when(opens, T.first_word(T.js_trim(part(1)))).otherwise("").alias("sender"),
        F.when(opens, part(2)).otherwise("").alias("time"),
        F.when(opens, part(3)).otherwise(F.col("line")).alias("text"),
        (~opens).alias("continues"),
    )
