"""Keeping stored tables: insert-or-ignore, upsert, delete with dependants.

Tables are immutable DataFrames; each function gives the new content, which the
caller writes where the cluster keeps its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators.ordered import join_null_safe
from chatloom.session import durable

MESSAGE_KEY = ["chat_id", "timestamp", "sender", "content"]


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key.  An aggregate, not a window: many copies of one key
    are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return picked.select(*keys, "__r.*").select(*rows.columns)


def latest_per_key(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r"))
    return picked.select(*keys, "__r.*").select(*rows.columns)


def insert_or_ignore(
    stored: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """The rows of `new` that are really inserted: first per key, not stored yet."""
    fresh = first_per_key(new, keys, order)
    if stored is None:
        return fresh
    return fresh.join(stored.select(*keys), keys, "left_anti")


def insert_messages(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    return insert_or_ignore(stored, new, MESSAGE_KEY, ["line_number"])


def new_files(files: DataFrame, chats: DataFrame | None) -> DataFrame:
    """Files whose hash no chat has; of equal files in one batch the first by name."""
    fresh = files.groupBy("file_hash").agg(F.min("file").alias("file"))
    if chats is None:
        return fresh
    return fresh.join(chats.select("file_hash"), "file_hash", "left_anti")


def chat_rows(messages: DataFrame, names: DataFrame | None = None, imported_at: int = 0) -> DataFrame:
    """One chat row per chat_id with its derived counts.  names: chat_id, name, file_hash."""
    counts = messages.groupBy("chat_id").agg(
        F.count_distinct("sender").cast("int").alias("participant_count"),
        F.count(F.lit(1)).cast("int").alias("message_count"),
        F.min("timestamp").alias("first_message_at"),
        F.max("timestamp").alias("last_message_at"),
    )
    if names is None:
        counts = counts.withColumn("name", F.col("chat_id")).withColumn(
            "file_hash", F.lit(None).cast("string")
        )
    else:
        counts = counts.join(names.select("chat_id", "name", "file_hash"), "chat_id", "left")
    return counts.select(
        F.col("chat_id").alias("id"), "name", F.lit("whatsapp").alias("source"),
        "participant_count", "message_count", "first_message_at", "last_message_at",
        F.lit(imported_at).cast("long").alias("imported_at"), "file_hash",
        F.lit("{}").alias("metadata"),
    )


def refresh_chats(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Recompute the counts of chats from their stored messages."""
    counts = messages.groupBy(F.col("chat_id").alias("id")).agg(
        F.count_distinct("sender").cast("int").alias("participant_count"),
        F.count(F.lit(1)).cast("int").alias("message_count"),
        F.min("timestamp").alias("first_message_at"),
        F.max("timestamp").alias("last_message_at"),
    )
    derived = ["participant_count", "message_count", "first_message_at", "last_message_at"]
    joined = chats.drop(*derived).join(counts, "id", "left")
    for c in derived[:2]:
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)))
    return joined.select(*chats.columns)


def update_summaries(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """Sessions with replaced summaries.  updates: session_id, summary."""
    new = updates.select(F.col("session_id").alias("id"), F.col("summary").alias("__s"))
    return (
        sessions.join(new, "id", "left")
        .withColumn("summary", F.coalesce("__s", "summary"))
        .select(*sessions.columns)
    )


def update_sessions(sessions: DataFrame, entities: DataFrame | None, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and entities after extraction results (session_id, summary,
    mentioned_entities): summaries are replaced, entities come on top of those stored; the
    same result twice adds nothing, as an entity's id names its session and place."""
    from chatloom.operators.people import entity_rows

    new = entity_rows(results.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi"))
    new = insert_or_ignore(entities, new, ["id"], ["session_id"])
    if entities is not None:
        new = entities.unionByName(new)
    once = first_per_key(results.select("session_id", "summary"), ["session_id"], ["summary"])
    return update_summaries(sessions, once), new


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Stored and new rows together, the latest version per key."""
    return latest_per_key(stored.unionByName(new), keys, version)


def upsert_profiles(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Contact profiles keyed by contact; defaults fill what a row leaves open."""
    ready = new.withColumn("model_used", F.coalesce("model_used", F.lit("llm-worker"))).withColumn(
        "id", F.coalesce("id", "contact_id")
    )
    return upsert(stored, ready, ["contact_id"], ["updated_at"])


def delete_rows(table: DataFrame, doomed: DataFrame, on: str, key: str = "id") -> DataFrame:
    return table.join(doomed.select(F.col(key).alias(on)).distinct(), on, "left_anti")


def replay(changes: DataFrame, keys: list[str], order: list[str], scope: list[str]) -> DataFrame:
    """The rows of a table after a log of changes.  changes: op (`put`, `delete`, `clear`),
    scope and key columns, order columns, and the row's other columns.

    Of every key the last change counts: a put is the row, a delete a tombstone.  A clear
    wipes all rows of its scope that were put before it; its key columns do not matter.
    Changes of one place in the order count as clear, delete, put, of equal ones the row that
    is greatest by its columns.  One aggregation keeps the
    last change per key and per scope's clears, both combined before the shuffle; scopes'
    last clears then meet the keys."""
    rank = F.when(F.col("op") == "clear", 0).when(F.col("op") == "delete", 1).otherwise(2)
    clears = F.col("op") == "clear"
    # A clear is a row of its scope without a key.
    keyed = changes.select(
        *scope, *[F.when(~clears, F.col(k)).alias(k) for k in keys if k not in scope], clears.alias("__clear"),
        F.struct(*order, rank.alias("rank")).alias("__at"), F.struct(*[c for c in changes.columns if c not in (*scope, *keys)]).alias("__row"))
    names = list(dict.fromkeys([*scope, *keys]))
    last = durable(keyed.groupBy(*names, "__clear").agg(F.max("__at").alias("__at"), F.max_by("__row", F.struct("__at", "__row")).alias("__row")))
    wiped = last.filter("__clear").groupBy(*scope).agg(F.max("__at").alias("__wiped"))
    alive = last.filter("not __clear and __row.op = 'put'")
    kept = join_null_safe(alive, wiped, scope, "left").filter(F.col("__wiped").isNull() | (F.col("__at") > F.col("__wiped")))
    return kept.select(*names, "__row.*").drop("op").select(*[c for c in changes.columns if c != "op"])


def delete_chats(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Delete chats with all that hangs on them.  doomed: id.  Memories stay but
    lose the session they came from."""
    sessions = tables["sessions"]
    dead_sessions = sessions.join(
        doomed.select(F.col("id").alias("chat_id")).distinct(), "chat_id", "left_semi"
    ).select("id")
    out = {
        "chats": delete_rows(tables["chats"], doomed, "id"),
        "messages": delete_rows(tables["messages"], doomed, "chat_id"),
        "sessions": delete_rows(sessions, doomed, "chat_id"),
    }
    for name in ("entities", "person_mentions", "pending_mentions"):
        if name in tables:
            out[name] = delete_rows(tables[name], dead_sessions, "session_id")
    if "person_key_memories" in tables:
        memories = tables["person_key_memories"]
        gone = dead_sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("__gone"))
        out["person_key_memories"] = (
            memories.join(gone, "session_id", "left")
            .withColumn("session_id", F.when(F.col("__gone").isNull(), F.col("session_id")))
            .select(*memories.columns)
        )
    return out


def expired_chats(chats: DataFrame, days: int, now: int) -> DataFrame:
    """Chats without a message in the last `days` days."""
    return chats.filter(F.coalesce("last_message_at", F.lit(0)) < now - days * 86400).select("id")


def encode_metadata(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def decode_metadata(column: str, schema: str) -> Column:
    return F.from_json(F.coalesce(column, F.lit("{}")), schema)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def with_message_ids(messages: DataFrame) -> DataFrame:
    return messages.withColumn("id", T.stable_id(*[F.col(c) for c in MESSAGE_KEY]))
