"""Aggregates and columns of the overview screens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators.ordered import Ordered
from chatloom.operators.search import top_k

TOP_PEOPLE = 5
PAGE_ITEMS = 100


def top_people(people: DataFrame, n: int = TOP_PEOPLE) -> DataFrame:
    return people.orderBy(F.desc("message_count"), "id").limit(n)


def home_totals(chats: DataFrame, people: DataFrame, tags: DataFrame, memories: DataFrame) -> DataFrame:
    """One row.  Tags and memories are those of the five most active people."""
    top = top_people(people).select(F.col("id").alias("person_id"))
    of_top = lambda df: df.join(F.broadcast(top), "person_id", "left_semi")
    one = lambda df, e, n: df.agg(e.alias(n)).scalar().alias(n)
    n = F.count(F.lit(1))
    return chats.agg(n.alias("chat_count"), F.sum("message_count").cast("long").alias("message_count")).select(
        "chat_count", "message_count", one(people, n, "people_count"),
        one(of_top(tags), n, "tag_count"), one(of_top(memories), n, "memory_count"),
    )


def featured_people(people: DataFrame, tags: DataFrame, n: int = 3) -> DataFrame:
    """The most active people with initials, first name and two tags."""
    top = top_people(people, n)
    first_tags = top_k(
        tags.join(F.broadcast(top.select(F.col("id").alias("person_id"))), "person_id", "left_semi"),
        ["person_id"], ["created_at", "tag"], 2,
    ).groupBy(F.col("person_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("__t")
    )
    return top.join(first_tags, "id", "left").select(
        "id", T.initials(F.col("name")).alias("initials"), T.first_word(F.col("name")).alias("name"),
        "message_count",
        F.coalesce(F.array_join(F.transform("__t", lambda x: x["tag"]), ", "), F.lit("")).alias("tags"),
    )


def recent_chats(chats: DataFrame, n: int = 3) -> DataFrame:
    return chats.orderBy(F.desc(F.coalesce("last_message_at", F.lit(0))), "id").limit(n).select(
        "id", "name", "message_count", "last_message_at"
    )


def relative_labels(chats: DataFrame, now: int) -> DataFrame:
    return chats.select("id", T.relative_time(F.col("last_message_at"), F.lit(now)).alias("label"))


def person_cards(people: DataFrame, tags: DataFrame, memories: DataFrame, page: int = PAGE_ITEMS) -> DataFrame:
    """People with all their tags and memories, in pages of bounded length: one
    row per person, kind and page, oldest first.  A person without any has one
    row with an empty page."""
    items = tags.select("person_id", F.lit("tag").alias("kind"), F.col("tag").alias("item"), "created_at").unionByName(
        memories.select("person_id", F.lit("memory").alias("kind"), F.col("memory").alias("item"), "created_at")
    )
    placed = Ordered.over(items, ["person_id", "kind"], ["created_at", "item"]).row_number("pos").result()
    pages = placed.withColumn("page", F.floor((F.col("pos") - 1) / page).cast("long")).groupBy(
        "person_id", "kind", "page"
    ).agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("__i"))
    pages = pages.select(
        F.col("person_id").alias("id"), "kind", "page", F.transform("__i", lambda x: x["item"]).alias("items")
    )
    return people.select(
        "id", "name", T.initials(F.col("name")).alias("initials"), "message_count"
    ).join(pages, "id", "left")


def graph_edges(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "strength")


def node_weights(people: DataFrame) -> DataFrame:
    return people.select("id", (22 + F.least(F.col("message_count") / 500, F.lit(14.0))).alias("weight"))


def pivot_flags(rows: DataFrame) -> DataFrame:
    """Whether a mention's context contains the message text."""
    return rows.withColumn("is_pivot", F.coalesce(F.contains("context", "content"), F.lit(False)))
