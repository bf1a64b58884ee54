"""From search results to the text given to an answering model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import constants as K
from chatloom.functions import dates
from chatloom.functions import text as T
from chatloom.operators import search
from chatloom.operators.extraction import QueryRules, classify_queries, expand_keywords, validated
from chatloom.session import durable


def prompts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, system_prompt, user_prompt for queries with results.  results:
    query_id, rank, start_time (may be null), sender, content; a query has as
    many rows as its top list."""
    date = F.coalesce(T.iso_instant(F.col("start_time")), F.lit(""))
    block = F.concat(F.lit("["), date, F.lit(" - "), "sender", F.lit("]: "), "content")
    grouped = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("__b"),
        F.min("start_time").alias("__lo"), F.max("start_time").alias("__hi"),
    )
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    head, rest = K.DATE_RULE.split("{lo}")
    middle, tail = rest.split("{hi}")
    rule = F.when(
        F.col("__lo").isNotNull(),
        F.concat(F.lit(head), day(F.col("__lo")), F.lit(middle), day(F.col("__hi")), F.lit(tail)),
    ).otherwise("")
    joined = F.array_join(F.transform("__b", lambda x: x["b"]), "\n\n")
    return grouped.join(queries.select("query_id", "text"), "query_id").select(
        "query_id",
        F.concat(F.lit(K.SYSTEM_PROMPT), rule).alias("system_prompt"),
        F.concat(
            F.lit(K.USER_PROMPT_HEAD), joined, F.lit(K.USER_PROMPT_QUESTION), "text",
            F.lit(K.USER_PROMPT_TAIL),
        ).alias("user_prompt"),
    )


def ask_questions(
    questions: DataFrame, now: int, rules: QueryRules, synonyms: DataFrame, messages: DataFrame, sessions: DataFrame,
    entities: DataFrame, chats: DataFrame,
) -> DataFrame:
    """From question texts to prompts: intent, keywords and dates of each text, synonyms, names
    of the entities it points at, retrieval by intent, prompt.  questions: query_id, text.

    Questions that read the same are searched once.  Every question gets a row: intent,
    date_from, date_to, results, and the prompt, null where nothing was found.  A null text
    counts as empty."""
    named = questions.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__text_id", F.sha2("text", 256))
    texts = named.select(F.col("__text_id").alias("query_id"), "text").distinct()
    judged = validated(classify_queries(texts, rules))
    dated = dates.with_date_range(judged, F.col("text"), F.lit(now)).withColumn("chat_id", F.lit(None).cast("string"))
    # As long as the list of different questions, and read by every search below.
    asked = durable(expand_keywords(dated, synonyms))
    results = durable(search.routed_search(asked, messages, sessions, entities, chats))
    many = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    told = asked.select("query_id", "intent", "date_from", "date_to").join(many, "query_id", "left").join(
        prompts(asked, results), "query_id", "left")
    return named.select("query_id", "__text_id").join(told.withColumnRenamed("query_id", "__text_id"), "__text_id").select(
        "query_id", "intent", "date_from", "date_to", F.coalesce("results", F.lit(0)).alias("results"), "system_prompt", "user_prompt")


def fixed_answers(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Queries nothing was found for."""
    return queries.join(results.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", F.lit(K.NO_CONTEXT_ANSWER).alias("answer")
    )


def fallback_answers(results: DataFrame) -> DataFrame:
    """Numbered context list, used when the answering model fails."""
    date = F.coalesce(T.iso_instant(F.col("start_time")), F.lit(""))
    block = F.concat(date, F.lit(" "), "sender", F.lit(": "), "content")
    grouped = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("__b")
    )
    numbered = F.transform(
        "__b", lambda x, i: F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] "), x["b"])
    )
    return grouped.select(
        "query_id", F.concat(F.lit(K.FAILED_ANSWER), F.array_join(numbered, "")).alias("answer")
    )


def citations(results: DataFrame) -> DataFrame:
    date = F.coalesce(T.iso_instant(F.col("start_time")), F.lit(""))
    who = F.when(F.col("sender") == "System", "Root").otherwise(F.col("sender"))
    return results.select(
        "query_id", "rank",
        F.concat(F.lit("["), date, F.lit("] "), "chat_name", F.lit(" — "), who).alias("meta"),
        F.col("content").alias("text"),
    )
