"""Plain reads of stored tables.  Batched by a table of wanted keys where the
single-user form takes one id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators.ordered import Ordered


def all_chats(chats: DataFrame) -> DataFrame:
    return chats.orderBy(F.desc("imported_at"), "id")


def by_ids(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    return table.join(wanted.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def chat_page(messages: DataFrame, chat_id: str, limit: int = 1000, offset: int = 0) -> DataFrame:
    return (
        messages.filter(F.col("chat_id") == chat_id)
        .orderBy("timestamp", "line_number").offset(offset).limit(limit)
    )


def chat_pages(messages: DataFrame, limit: int = 1000, offset: int = 0) -> DataFrame:
    """The same page of every chat."""
    rows = Ordered.over(messages, ["chat_id"], ["timestamp", "line_number"]).row_number("pos")
    return rows.result().filter((F.col("pos") > offset) & (F.col("pos") <= offset + limit))


def counts_per_chat(table: DataFrame, name: str = "count") -> DataFrame:
    return table.groupBy("chat_id").agg(F.count(F.lit(1)).alias(name))


def chat_participants(messages: DataFrame) -> DataFrame:
    return (
        messages.filter(F.col("type") != "system")
        .groupBy("chat_id", "sender").agg(F.count(F.lit(1)).alias("message_count"))
        .orderBy("chat_id", F.desc("message_count"), "sender")
    )


def chat_sessions(sessions: DataFrame, chat_id: str) -> DataFrame:
    return sessions.filter(F.col("chat_id") == chat_id).orderBy("start_time", "id")


def entities_by_chat(entities: DataFrame, sessions: DataFrame) -> DataFrame:
    return entities.join(sessions.select(F.col("id").alias("session_id"), "chat_id"), "session_id")


def people_by_activity(people: DataFrame) -> DataFrame:
    last = [F.desc("last_seen")] if "last_seen" in people.columns else []
    return people.orderBy(F.desc("message_count"), *last, "id")


def all_relations(relations: DataFrame, kind: str = "co_occurrence") -> DataFrame:
    """Relations with their type; those counted from shared contexts have none of
    their own and get `kind`."""
    typed = relations if "relation_type" in relations.columns else relations.withColumn("relation_type", F.lit(kind))
    return typed.select("source_id", "target_id", "relation_type", "strength")


def person_items(items: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """Tags or memories of the wanted people, oldest first."""
    kept = items.join(wanted.select(F.col("id").alias("person_id")).distinct(), "person_id", "left_semi")
    return kept.select("person_id", value, "created_at").orderBy("person_id", "created_at", value)


def facts_by_evidence(facts: DataFrame, contact_id: str | None = None) -> DataFrame:
    chosen = facts if contact_id is None else facts.filter(F.col("contact_id") == contact_id)
    return chosen.orderBy(F.desc("evidence"), "text")


def block_summaries(blocks: DataFrame, contact_id: str) -> DataFrame:
    return blocks.filter(F.col("contact_id") == contact_id).orderBy("block_index")


def filtered(
    messages: DataFrame,
    chats: DataFrame | None = None,
    senders: DataFrame | None = None,
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """Messages of listed chats (id) and senders (sender) inside a period."""
    out = messages
    if start is not None:
        out = out.filter(F.col("timestamp") >= start)
    if end is not None:
        out = out.filter(F.col("timestamp") <= end)
    if chats is not None:
        out = out.join(chats.select(F.col("id").alias("chat_id")).distinct(), "chat_id", "left_semi")
    if senders is not None:
        out = out.join(senders.select("sender").distinct(), "sender", "left_semi")
    return out
