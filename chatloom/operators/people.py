"""People, aliases, mentions and what is known about people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import constants as K
from chatloom.functions import text as T
from chatloom.operators.ordered import Ordered
from chatloom.operators.store import first_per_key, insert_or_ignore

BLOCK_MENTIONS = 200


def person_color(name: Column) -> Column:
    """A palette entry that stays the same for the same name."""
    palette = F.array(*[F.lit(c) for c in K.PALETTE])
    place = F.conv(F.substring(F.sha2(name, 256), 1, 6), 16, 10).cast("long") % len(K.PALETTE)
    return F.element_at(palette, (place + 1).cast("int"))


def person_key(name: Column) -> Column:
    return T.stable_id(F.lit("person"), F.lower(name))


def sender_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("sender").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("timestamp").alias("last_seen")
    )


def merge_senders(people: DataFrame, messages: DataFrame) -> DataFrame:
    """People after an import: known names (any case) gain messages, others are
    created.  Of people with equal names the one with the smallest id gains."""
    counts = (
        sender_counts(messages).filter(F.lower("sender") != K.SYSTEM_SENDER)
        .groupBy(F.lower("sender").alias("__k"))
        .agg(
            F.min("sender").alias("sender"), F.sum("message_count").alias("__n"),
            F.max("last_seen").alias("__seen"),
        )
    )
    first = people.groupBy(F.lower("name").alias("__k")).agg(F.min("id").alias("id"))
    # A new name has no id here and meets nobody.
    joined = people.join(counts.join(first, "__k", "left"), "id", "full_outer")
    new = F.col("id").isNull()
    return joined.select(
        F.coalesce("id", person_key(F.col("sender"))).alias("id"),
        F.coalesce("name", "sender").alias("name"),
        F.coalesce("color" if "color" in people.columns else F.lit(None), person_color(F.coalesce("name", "sender"))).alias("color"),
        (F.coalesce("message_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("message_count"),
        F.greatest("last_seen" if "last_seen" in people.columns else F.lit(None).cast("long"), "__seen").alias("last_seen"),
        new.alias("created"),
    )


def new_aliases(merged: DataFrame) -> DataFrame:
    """The first alias of every person created by `merge_senders`."""
    return merged.filter("created").select(F.col("id").alias("person_id"), F.col("name").alias("alias"))


# --- mentions ----------------------------------------------------------------

def entity_rows(extracted: DataFrame) -> DataFrame:
    """Entity rows from extraction results (session_id, mentioned_entities)."""
    flat = extracted.select("session_id", F.posexplode("mentioned_entities").alias("place", "e"))
    filled = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    return flat.filter(F.coalesce("e.name", F.lit("")) != "").select(
        T.stable_id(F.col("session_id"), F.col("place")).alias("id"),
        "session_id",
        F.col("e.name").alias("name"),
        T.js_trim(F.lower("e.name")).alias("normalized_name"),
        filled("e.type", K.ENTITY_DEFAULT_TYPE).alias("type"),
        filled("e.context", K.ENTITY_DEFAULT_ACTION).alias("action"),
        F.col("e.context").alias("context"),
        (F.coalesce("e.is_participant", F.lit(False))).alias("is_participant"),
    )


def route_mentions(entities: DataFrame, people: DataFrame) -> DataFrame:
    """Mentions of people outside the chat, with the person of exactly that name
    (any case) or, without one, a null person: those wait in the inbox."""
    outside = entities.filter(~F.col("is_participant") & (F.col("type") == "person"))
    named = (
        people.groupBy(F.lower("name").alias("__k")).agg(F.min("id").alias("person_id"))
    )
    return outside.withColumn("__k", F.lower("name")).join(named, "__k", "left").drop("__k")


def linked_mentions(routed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    rows = routed.filter("person_id is not null").select("session_id", "person_id", "context", "id")
    new = insert_or_ignore(
        stored.select("session_id", "person_id") if stored is not None else None,
        rows, ["session_id", "person_id"], ["id"],
    )
    return new.drop("id").withColumn("processed", F.lit(False))


def pending_mentions(routed: DataFrame, at_ms: int = 0) -> DataFrame:
    return routed.filter("person_id is null").select(
        F.col("id"), "session_id", F.col("name").alias("alias"), "context",
        F.lit(at_ms).cast("long").alias("timestamp"),
    )


def link_mentions(stored: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    return insert_or_ignore(stored, new, ["session_id", "person_id"], order)


def inbox(pending: DataFrame) -> DataFrame:
    return pending.orderBy("timestamp", "id")


def alias_key(alias: Column) -> Column:
    return F.lower(T.js_trim(alias))


def clones(pending: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pending mentions with the same alias as a chosen one (id)."""
    keyed = pending.withColumn("__k", alias_key(F.col("alias")))
    keys = keyed.join(chosen.select("id").distinct(), "id", "left_semi").select("__k").distinct()
    return keyed.join(keys, "__k", "left_semi").drop("__k")


def _decided(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every pending mention whose alias a valid decision covers; of several
    decisions on one alias the one with the smallest mention id counts."""
    keyed = pending.withColumn("__k", alias_key(F.col("alias")))
    valid = decisions.filter(
        F.col("action").isin("create_new", "ignore")
        | ((F.col("action") == "link_existing") & F.col("person_id").isNotNull())
    )
    first = (
        keyed.select(F.col("id").alias("mention_id"), "__k", F.col("alias").alias("chosen_alias"))
        .join(valid, "mention_id")
    )
    first = first_per_key(first, ["__k"], ["mention_id"])
    return keyed.join(
        first.select("__k", "action", "chosen_alias", F.col("person_id").alias("__p")), "__k"
    ).withColumn(
        "person_id", F.when(F.col("action") == "create_new", person_key(F.col("chosen_alias"))).otherwise(F.col("__p"))
    )


def resolve_mentions(pending: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Apply decisions (mention_id, action, person_id) to mentions and their
    clones.  Gives new people, aliases, mention links, what stays pending, and
    the decisions that could not be applied."""
    decided = _decided(pending, decisions)
    created = decided.filter("action = 'create_new'")
    kept = decided.filter("action <> 'ignore'")
    people = created.select("person_id", "chosen_alias").distinct().select(
        F.col("person_id").alias("id"), F.col("chosen_alias").alias("name"),
        person_color(F.col("chosen_alias")).alias("color"),
    )
    aliases = kept.select("person_id", F.col("chosen_alias").alias("alias")).distinct()
    links = first_per_key(
        kept.select("session_id", "person_id", "context", "id"), ["session_id", "person_id"], ["id"]
    ).drop("id")
    left = pending.join(decided.select("id"), "id", "left_anti")
    missing = decisions.join(pending.select(F.col("id").alias("mention_id")), "mention_id", "left_anti")
    errors = missing.select("mention_id", F.lit("mention_not_found").alias("reason")).unionByName(
        decisions.filter("action = 'link_existing' AND person_id IS NULL")
        .join(missing.select("mention_id"), "mention_id", "left_anti")
        .select("mention_id", F.lit("person_id_required").alias("reason"))
    )
    return {"people": people, "aliases": aliases, "mentions": links, "pending": left, "errors": errors}


# --- knowledge ---------------------------------------------------------------

def insert_tags(stored: DataFrame | None, new: DataFrame, source: str = K.TAG_SOURCE) -> DataFrame:
    """New (person, tag) pairs; the oldest offer of a pair counts."""
    fresh = new.groupBy("person_id", "tag").agg(F.min("created_at").alias("created_at"))
    if stored is not None:
        fresh = fresh.join(stored.select("person_id", "tag"), ["person_id", "tag"], "left_anti")
    return fresh.select(
        T.stable_id(F.col("person_id"), F.col("tag")).alias("id"), "person_id", "tag",
        F.lit(source).alias("source"), "created_at",
    )


def memory_rows(offered: DataFrame) -> DataFrame:
    """Trimmed, non-blank memories.  offered: person_id, memory, session_id, created_at."""
    text = T.js_trim(F.coalesce("memory", F.lit("")))
    return offered.withColumn("memory", text).filter("memory <> ''").select(
        T.stable_id(F.col("person_id"), F.col("session_id"), F.col("memory")).alias("id"),
        "person_id", "memory", "session_id", "created_at",
    )


def unprocessed_mentions(mentions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Mentions not looked at yet, with their session's summary if it is there."""
    summaries = sessions.select(F.col("id").alias("session_id"), "summary")
    return (
        mentions.filter(~F.col("processed"))
        .join(summaries, "session_id", "left")
        .select("session_id", "person_id", "context", "summary")
    )


def context_blocks(unprocessed: DataFrame, size: int = BLOCK_MENTIONS) -> DataFrame:
    """Context text per person in numbered parts of `size` mentions.  A person
    with few mentions has one part; one with very many has many parts of bounded
    size, which together hold every line."""
    rows = Ordered.over(unprocessed, ["person_id"], ["session_id"]).row_number("pos").result()
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    lines = F.array_compact(
        F.array(
            F.when(given("summary"), F.concat(F.lit('- Sessão: "'), "summary", F.lit('"'))),
            F.when(given("context"), F.concat(F.lit('  Contexto da menção: "'), "context", F.lit('"'))),
        )
    )
    # A person's memories go back to the first session, whatever part they come from.
    first = unprocessed.groupBy("person_id").agg(F.min("session_id").alias("first_session"))
    parts = rows.withColumn("part", F.floor((F.col("pos") - 1) / size).cast("long")).groupBy(
        "person_id", "part"
    ).agg(
        F.array_sort(F.collect_list(F.struct("pos", "session_id", lines.alias("lines")))).alias("__c")
    )
    return parts.join(first, "person_id").select(
        "person_id", "part", "first_session",
        F.size("__c").cast("long").alias("mentions"),
        F.array_join(F.flatten(F.transform("__c", lambda x: x["lines"])), "\n").alias("context"),
    )


def mark_processed(mentions: DataFrame, done: DataFrame) -> DataFrame:
    """Mentions with the flag set for every (person_id, session_id) of `done`."""
    flags = done.select("person_id", "session_id").distinct().withColumn("__d", F.lit(True))
    return (
        mentions.join(flags, ["person_id", "session_id"], "left")
        .withColumn("processed", F.col("processed") | F.coalesce("__d", F.lit(False)))
        .select(*mentions.columns)
    )


def pass_metrics(
    answers: DataFrame, offered_tags: DataFrame, inserted_tags: DataFrame, memories: DataFrame, now: int = 0
) -> DataFrame:
    """One row: people handled, tags offered and inserted, memories, people without an
    answer, one of their errors (null if none), and when the pass ran.  answers: person_id,
    status, errors."""
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n)).scalar().alias(n)
    bad = F.col("status") != "ok"
    counted = answers.agg(
        F.count_distinct(F.when(~bad, F.col("person_id"))).alias("people_processed"),
        F.count_distinct(F.when(bad, F.col("person_id"))).alias("people_failed"),
        F.max(F.when(bad, F.try_element_at("errors", F.lit(-1)))).alias("last_error"),
    )
    return counted.select(
        "people_processed", one(offered_tags, "tags_offered"), one(inserted_tags, "tags_inserted"),
        one(memories, "memories_inserted"), "people_failed", "last_error", F.lit(now).cast("long").alias("last_run"),
    )
