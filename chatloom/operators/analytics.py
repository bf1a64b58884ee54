"""Chat analytics, person relations, name variants and smaller specified jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import dates
from chatloom.functions import text as T
from chatloom.operators.ordered import Ordered, join_null_safe
from chatloom.session import durable

LINK = r"https?://[^\s<>\"']+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d ().-]{7,}\d"
DATE = r"\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}"


def activity(messages: DataFrame) -> DataFrame:
    """Messages and characters per chat, sender, day and hour."""
    at = F.timestamp_seconds("timestamp")
    return messages.groupBy(
        "chat_id", "sender", F.date_format(at, "yyyy-MM-dd").alias("day"), F.hour(at).cast("long").alias("hour")
    ).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.sum(T.utf16_length(F.col("content"))).alias("characters"),
    )


def activity_rollup(messages: DataFrame) -> DataFrame:
    """The same counts per (chat, sender), per chat and in total."""
    counts = messages.groupBy("chat_id", "sender").agg(F.count(F.lit(1)).alias("n"))
    return counts.rollup("chat_id", "sender").agg(
        F.sum("n").alias("message_count"), F.grouping_id().cast("long").alias("level")
    )


# --- relations ---------------------------------------------------------------

# People of a context whose pairs one task may make; a larger context is a grid of blocks.
CONTEXT_BLOCK = 1000
# Pairs that one task makes and counts, about.
TASK_PAIRS = 1_000_000


def shared_contexts(memberships: DataFrame, context: str = "context_id", person: str = "person_id") -> DataFrame:
    """Person pairs (source_id < target_id) by number of shared contexts.

    People repeated in a context are first made one.  Small contexts pair up as a whole.  A
    context of more than `CONTEXT_BLOCK` people is cut into blocks by a hash of the person;
    its pairs are those of each block with itself and with every later block, a cell of that
    triangle being one group, so no context lands in one task, and each cell's counts are
    combined before they are shuffled.  Contexts are dealt to as many tasks as their pairs
    need, so that a task counts about `TASK_PAIRS` of them, however many there are."""
    once = durable(memberships.select(F.col(context).alias("c"), F.col(person).alias("p")).filter("c is not null and p is not null").distinct())
    sizes = once.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    heavy = durable(sizes.filter(F.col("n") > CONTEXT_BLOCK).select("c", F.ceil(F.col("n") / CONTEXT_BLOCK).cast("int").alias("blocks")))
    # Two numbers: the pairs of contexts that are whole, and of cells.
    many = F.col("n") * F.col("n") / 2
    small, large = sizes.agg(F.sum(F.when(F.col("n") <= CONTEXT_BLOCK, many)), F.sum(F.when(F.col("n") > CONTEXT_BLOCK, many))).first()
    tasks = lambda made: max(once.sparkSession.sparkContext.defaultParallelism, int((made or 0) // TASK_PAIRS) + 1)
    light = once.join(heavy, "c", "left_anti").repartition(tasks(small), "c")
    pairs = light.select("c", F.col("p").alias("a")).join(light.select("c", F.col("p").alias("b")), "c").filter("a < b").select("a", "b")
    dealt = once.join(heavy, "c").withColumn("block", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int"))
    rows = dealt.select("c", F.col("p").alias("a"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    columns = dealt.select("c", F.col("p").alias("b"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))
    cell = ["c", "i", "j"]
    cells = rows.repartition(tasks(large), *cell).join(columns.repartition(tasks(large), *cell), cell).filter("i < j or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(cells).groupBy(F.col("a").alias("source_id"), F.col("b").alias("target_id")).agg(F.count(F.lit(1)).alias("shared"))


def relations(memberships: DataFrame, context: str = "context_id", person: str = "person_id") -> DataFrame:
    """Person pairs by number of shared contexts; strength relative to the strongest pair.
    The result is the pair table itself, so a context of p people does contribute its
    pairs.  They are stored, since the strongest one is asked for as well."""
    pairs = durable(shared_contexts(memberships, context, person))
    strongest = pairs.agg(F.max("shared")).scalar()
    return pairs.withColumn("strength", F.round(F.col("shared") / strongest, 6))


def running_relations(memberships: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Pairs with the contexts they shared up to each time bucket in which they met: `upto`
    holds from `bucket` until before `until` (null: for good).  memberships: context_id,
    person_id, bucket, a number that grows with time; a context lies in one bucket."""
    # The bucket joins the context's name, so that pairs are counted per bucket.
    keyed = memberships.select(F.struct(F.col(bucket).alias("bucket"), F.col("context_id")).alias("context_id"), "person_id").distinct()
    left = keyed.select("context_id", F.col("person_id").alias("source_id"))
    right = keyed.select("context_id", F.col("person_id").alias("target_id"))
    met = left.join(right, "context_id").filter("source_id < target_id").groupBy(
        "source_id", "target_id", F.col("context_id.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # A pair has at most one row per bucket.
    order = Window.partitionBy("source_id", "target_id").orderBy("bucket")
    return met.select(
        "source_id", "target_id", "bucket", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        F.lead("bucket").over(order).alias("until"))


def relations_in_period(running: DataFrame, first: int, last: int, people: DataFrame | None = None) -> DataFrame:
    """Pairs that shared contexts in the buckets from `first` to `last`: the difference of two
    rows of `running_relations` per pair, whatever the period's length.  With `people`
    (person_id), only pairs of two of them; strength relative to the strongest pair left."""
    at = lambda bucket, name: running.filter((F.col("bucket") <= bucket) & (F.col("until").isNull() | (F.col("until") > bucket))).select(
        "source_id", "target_id", F.col("upto").alias(name))
    both = at(last, "later").join(at(first - 1, "earlier"), ["source_id", "target_id"], "left")
    pairs = both.withColumn("shared", F.col("later") - F.coalesce("earlier", F.lit(0))).filter("shared > 0").drop("later", "earlier")
    if people is not None:
        for end in ("source_id", "target_id"):
            pairs = pairs.join(people.select(F.col("person_id").alias(end)).distinct(), end, "left_semi")
    pairs = durable(pairs.select("source_id", "target_id", "shared"))
    return pairs.withColumn("strength", F.round(F.col("shared") / pairs.agg(F.max("shared")).scalar(), 6))


def strong_edges(edges: DataFrame, least: float) -> DataFrame:
    """Edges of at least `least` strength, and how many of them each end has."""
    kept = edges.filter(F.col("strength") >= least)
    ends = kept.select(F.explode(F.array("source_id", "target_id")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("d"))
    degree = lambda end: ends.select(F.col("p").alias(f"{end}_id"), F.col("d").alias(f"{end}_degree"))
    return kept.join(degree("source"), "source_id").join(degree("target"), "target_id").select(
        "source_id", "target_id", "strength", "source_degree", "target_degree")


def window_memberships(messages: DataFrame, seconds: int = 3600) -> DataFrame:
    """(chat, time window) contexts and the people who speak in them."""
    slot = F.floor(F.col("timestamp") / seconds)
    return messages.filter("type <> 'system'").select(
        F.concat_ws("|", "chat_id", slot.cast("string")).alias("context_id"), F.col("sender").alias("person_id")
    ).distinct()


# --- name variants -----------------------------------------------------------

def _deletions(name):
    """The name with up to two characters removed.  Two names at edit distance
    two or less always have one of these in common."""
    size = F.length(name)
    cut = lambda s, i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.length(s)))
    places = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    one = F.transform(places(size), lambda i: cut(name, i))
    two = F.flatten(
        F.transform(
            places(size),
            lambda i: F.transform(
                F.filter(places(size - 1), lambda j: j >= i), lambda j: cut(cut(name, i), j)
            ),
        )
    )
    return F.array_distinct(F.concat(F.array(name), one, two))


# Names that may share one segment at one place before they meet by deletions instead.
HOT_SEGMENT = 200
# Names whose forms one task makes, and whose share of the forms one task compares.
TASK_NAMES = 500


def _segments(size):
    """(place, length) of three nearly equal pieces of a name of the given length."""
    base, more = F.floor(size / 3).cast("int"), size % 3
    return [(i * base + F.greatest(F.lit(0), more - 3 + i), base + (F.lit(i) >= 3 - more).cast("int")) for i in range(3)]


def _own_segments(name):
    size = F.length(name)
    return F.array(*[
        F.struct(size.alias("size"), F.lit(i).alias("i"), F.substr(name, at + 1, many).alias("piece")) for i, (at, many) in enumerate(_segments(size))])


def _offered_segments(name):
    """Pieces of a name that a name up to two letters shorter may have as a segment: at a
    shift by which the lengths before and behind it differ by two letters at most in all."""
    size, out = F.length(name), []
    for less in range(3):
        for i, (at, many) in enumerate(_segments(size - less)):
            for shift in range(-2, 3):
                if abs(shift) + abs(less - shift) > 2:
                    continue
                fits = (size > less) & (at + shift >= 0) & (at + shift + many <= size)
                out.append(F.when(fits, F.struct(
                    (size - less).alias("size"), F.lit(i).alias("i"), F.substr(name, at + shift + 1, many).alias("piece"))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def name_variants(names: DataFrame, name: str = "name") -> DataFrame:
    """Pairs of different normalised names at edit distance 1 or 2.

    Of three segments of a name two edits leave one untouched, so a name meets another when
    one of its segments stands in the other at a place the edits allow: a few keys per name.
    Names that share a segment with many, as with a common prefix, meet only when they also
    share a form with up to two letters deleted.  The exact distance decides."""
    once = durable(names.select(T.fold(T.js_trim(F.col(name))).alias("n")).filter("n <> ''").distinct())
    # A name is a few bytes and becomes hundreds of forms and pairs, which its size does not
    # tell: the number of names says into how many tasks the forms go.
    tasks = max(once.sparkSession.sparkContext.defaultParallelism, once.count() // TASK_NAMES + 1)
    once = once.repartition(tasks, "n")
    own = once.select("n", F.inline(_own_segments(F.col("n"))))
    key = ["size", "i", "piece"]
    hot = durable(own.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_SEGMENT).drop("__n"))
    offered = once.select("n", F.inline(_offered_segments(F.col("n"))))
    dealt_out = lambda rows, *by: rows.repartition(tasks, *by).hint("merge")
    some = dealt_out(own.join(hot, key, "left_anti").withColumnRenamed("n", "a"), *key).join(
        dealt_out(offered.withColumnRenamed("n", "b"), *key), key).select("a", "b")
    # Both names of a pair that meets in a hot segment have it.
    crowded = own.join(hot, key, "left_semi").select("n").union(offered.join(hot, key, "left_semi").select("n")).distinct()
    keyed = crowded.repartition(tasks, "n").select("n", F.explode(_deletions(F.col("n"))).alias("v"))
    alike = dealt_out(keyed.withColumnRenamed("n", "a"), "v").join(dealt_out(keyed.withColumnRenamed("n", "b"), "v"), "v").filter("a < b").select("a", "b")
    # Names that meet are compared at once: far more meet, and meet several times, than are
    # near, and only those that are near are shuffled to be told once.
    near = some.filter(F.col("a") != F.col("b")).unionByName(alike).filter(F.abs(F.length("a") - F.length("b")) <= 2)
    near = near.select(F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b"))
    near = near.withColumn("distance", F.levenshtein("name_a", "name_b", 2).cast("long")).filter("distance between 1 and 2")
    return near.distinct()


def unify_names(rows: DataFrame, variants: DataFrame, name: str = "normalized_name") -> DataFrame:
    """Replace variants by their canonical name.  variants: variant, canonical."""
    known = variants.groupBy("variant").agg(F.min("canonical").alias("canonical"))
    return (
        rows.join(known.withColumnRenamed("variant", name), name, "left")
        .withColumn("canonical_name", F.coalesce("canonical", name)).drop("canonical")
    )


# --- query cache and history ---------------------------------------------------

def cached_results(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries with the stored answer for exactly their text, null if none."""
    return queries.join(
        cache.select(F.col("query_text").alias("text"), "result_chunks", "llm_response"), "text", "left"
    )


def count_cache_hits(cache: DataFrame, queries: DataFrame) -> DataFrame:
    hits = queries.groupBy(F.col("text").alias("query_text")).agg(F.count(F.lit(1)).alias("__h"))
    return (
        cache.join(hits, "query_text", "left")
        .withColumn("hit_count", F.col("hit_count") + F.coalesce("__h", F.lit(0)))
        .select(*cache.columns)
    )


def search_history(results: DataFrame, queries: DataFrame, at: int = 0) -> DataFrame:
    """One history row per query with its number of results."""
    found = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.join(found, "query_id", "left").select(
        "query_id", F.col("text").alias("query"), F.coalesce("n", F.lit(0)).alias("result_count"),
        F.lit(at).cast("long").alias("created_at"),
    )


def history_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("query").agg(F.count(F.lit(1)).alias("times"), F.sum("result_count").alias("results"))


# --- extraction by pattern -----------------------------------------------------

def extracted_items(messages: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """Links, mail addresses, phone numbers and dates of each message."""
    def found(kind: str, pattern: str):
        hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    items = F.concat(found("link", LINK), found("email", EMAIL), found("phone", PHONE), found("date", DATE))
    return messages.select(*keys, F.inline(items))


def event_timeline(mentions: DataFrame, event: str, text: str, now: str) -> DataFrame:
    """When each event is said to happen: written dates become days, counted from the time of
    the mention (`now`, seconds), and mentions of one event whose days overlap or touch become
    one interval: event, first_day, last_day, mentions.

    Equal days of an event are counted first, so an event has as many rows as different
    spans of days, however often it is mentioned."""
    spans = dates.mentioned_days(mentions.filter(F.col(event).isNotNull()), F.col(text), F.col(now)).groupBy(
        F.col(event).alias("event"), "first_day", "last_day").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("event").orderBy("first_day", "last_day")
    reached = F.max("last_day").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", (reached.isNull() | (F.col("first_day") > F.date_add(reached, 1))).cast("int"))
    numbered = opened.withColumn("island", F.sum("new").over(order))
    return numbered.groupBy("event", "island").agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("n").alias("mentions")).drop("island")


# --- blocks ----------------------------------------------------------------------

def block_rows(messages: DataFrame, size: int = 50) -> DataFrame:
    """Numbered blocks of `size` messages per contact with dates and counts."""
    rows = Ordered.over(messages, ["chat_id"], ["timestamp", "line_number"]).row_number("pos").result()
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    return (
        rows.groupBy(
            F.col("chat_id").alias("contact_id"), F.floor((F.col("pos") - 1) / size).cast("long").alias("block_index")
        )
        .agg(
            day(F.min("timestamp")).alias("start_date"), day(F.max("timestamp")).alias("end_date"),
            F.count(F.lit(1)).alias("message_count"),
        )
    )


def profile_rows(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("contact_id").agg(
        F.sum("message_count").alias("message_count"),
        F.min("start_date").alias("date_range_start"), F.max("end_date").alias("date_range_end"),
        F.count(F.lit(1)).alias("block_count"),
    )


def usage_metrics(metrics: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean and exact percentiles of a measured value: the smallest value that
    has the wanted share of its group's values at or below it.  Equal values are
    counted first, and the running count over a large group is split like any order."""
    sizes = metrics.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"),
        F.max(value).alias("largest"), F.count(value).alias("__values"),
    )
    counts = metrics.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__c"))
    upto = Ordered.over(counts, [group], [value]).running_sum(F.col("__c"), "__upto").result()
    ranked = join_null_safe(upto, sizes.select(group, "__values"), [group])
    at = lambda p: F.min(F.when(F.col("__upto") >= F.col("__values") * p, F.col(value)))
    places = ranked.groupBy(group).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return join_null_safe(sizes, places, [group], "left").select(group, "n", "mean", "p50", "p95", "largest")
