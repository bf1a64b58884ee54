"""Incremental variants on Structured Streaming."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chatloom.functions import constants as K
from chatloom.functions import text as T
from chatloom.operators import extraction, parsing, people, store
from chatloom.session import durable, listed_by_few
from chatloom.sources.exports import chat_of, read_lines

DELAY = "1 hour"
FILE = "path string, modificationTime timestamp, length long, content binary"
MESSAGES = "chat_id string, sender string, content string, timestamp long, type string, line_number long"


def _write(df: DataFrame, path: str, batch: int) -> None:
    """Each batch owns its folder and overwrites it, so a repeated batch changes nothing."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of a stream's rows the first of every key, ever: what was seen is kept as state per
    key, so a batch costs what it brings, whatever came before.  Among rows of one batch the
    first by `order` counts."""
    def first(key, batches, state: GroupState):
        best = None
        for part in batches:
            if not state.exists:
                both = part if best is None else pd.concat([best, part])
                best = both if len(both) == 1 else both.sort_values(order, kind="stable", na_position="first")[:1]
        if best is not None:
            state.update((True,))
            yield best

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(*keys).applyInPandasWithState(first, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def import_stream(spark: SparkSession, incoming: str, tables: str, checkpoint: str, files_per_batch: int = 5000):
    """New export files into chats and messages under `tables`.  A file is hashed once;
    files whose hash came before, in any batch, are skipped.  Chosen files are then read
    line by line in splits.  The hash names the chat, so messages of different files never
    meet, and nothing stored is read again."""
    files = (
        listed_by_few(spark).readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(incoming)
        .select("path", F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("file_hash"))
    )

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        chosen = durable(batch)
        # At most `files_per_batch` names.
        paths = [r["path"] for r in chosen.select("path").collect()]
        names = chosen.select(chat_of(F.col("file")).alias("name"), "file", "file_hash", F.col("file_hash").alias("chat_id"))
        if paths:
            lines = read_lines(session, [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])
            lines = lines.join(F.broadcast(names.select("file", "file_hash")), "file").drop("file").withColumnRenamed("file_hash", "file")
            messages = durable(parsing.parse_lines(lines))
        else:
            messages = session.createDataFrame([], MESSAGES)
        _write(store.chat_rows(messages, names), f"{tables}/chats", number)
        _write(store.insert_messages(None, messages), f"{tables}/messages", number)

    return (
        first_seen(files, ["file_hash"], ["file"]).writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _timed(messages: DataFrame, delay: str) -> DataFrame:
    return messages.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", delay)


def gap_sessions(messages: DataFrame, gap: int = K.SESSION_GAP_SECONDS, delay: str = DELAY) -> DataFrame:
    """Sessions by pause over an arriving stream; a session is told once closed."""
    window = F.session_window("event_time", f"{gap} seconds")
    return (
        _timed(messages, delay).groupBy("chat_id", window)
        .agg(
            F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
            F.count(F.lit(1)).alias("message_count"),
        )
        .drop("session_window")
    )


SESSION_OUT = "chat_id string, start_time long, end_time long, message_count long"


def budget_sessions(
    messages: DataFrame, gap: int = K.SESSION_GAP_SECONDS, budget: int = K.SESSION_TOKENS, delay: str = DELAY
) -> DataFrame:
    """Sessions by pause and token budget, as over a table, whatever files the rows
    come in.

    Rows wait in the chat's state until the watermark has passed them, so that they
    are folded in event order; besides them the state is one open session, which is
    told by the row that ends it or when the watermark passes its pause."""
    rows = _timed(messages, delay).select(
        "chat_id", "event_time", "timestamp", "line_number", T.token_estimate(F.col("content")).alias("tokens")
    )
    columns = ["chat_id", "start_time", "end_time", "message_count"]

    def advance(key, batches, state: GroupState):
        start, last, total, n, waiting = None, None, 0, 0, []
        if state.exists:
            start, last, total, n, *held = state.get
            waiting = list(zip(*held))
        if not state.hasTimedOut:
            for part in batches:
                waiting += zip(part["timestamp"].tolist(), part["line_number"].tolist(), part["tokens"].tolist())
        waiting.sort()
        mark = state.getCurrentWatermarkMs()
        final = bisect_right(waiting, mark, key=lambda row: row[0] * 1000)
        done = []
        for at, _, tokens in waiting[:final]:
            if n and at - last <= gap and total + tokens <= budget:
                last, total, n = at, total + tokens, n + 1
                continue
            if n:
                done.append((key[0], start, last, n))
            start, last, total, n = at, at, tokens, 1
        waiting = waiting[final:]
        if n and (last + gap) * 1000 <= mark:
            done.append((key[0], start, last, n))
            start, last, total, n = None, None, 0, 0
        if n or waiting:
            state.update((start, last, total, n, *([r[i] for r in waiting] for i in range(3))))
            state.setTimeoutTimestamp(min(([(last + gap) * 1000] if n else []) + [r[0] * 1000 for r in waiting[:1]]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=columns)

    return rows.groupBy("chat_id").applyInPandasWithState(
        advance, SESSION_OUT,
        "start long, last long, total long, n long, times array<long>, lines array<long>, tokens array<long>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def distinct_messages(messages: DataFrame, delay: str = DELAY) -> DataFrame:
    """Drop repeated messages (chat, time, sender, content) inside the watermark."""
    return _timed(messages, delay).dropDuplicatesWithinWatermark(store.MESSAGE_KEY)


def window_counts(messages: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """Messages per sender and time window."""
    window = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    return (
        _timed(messages, delay).groupBy(window.alias("w"), "sender")
        .agg(F.count(F.lit(1)).alias("message_count"))
        .select(
            F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"),
            "sender", "message_count",
        )
    )


def pending_feed(extracted: DataFrame, known_people: DataFrame) -> DataFrame:
    """Mentions of unknown people out of a stream of extraction results."""
    return people.pending_mentions(people.route_mentions(people.entity_rows(extracted), known_people))


def knowledge_pass(
    mentions: DataFrame, sessions: DataFrame, tags: DataFrame | None, model, now: int = 0
) -> dict[str, DataFrame]:
    """One pass over unprocessed mentions: new tags and memories, the mentions with
    their flags, and the metrics row."""
    open_mentions = people.unprocessed_mentions(mentions, sessions)
    blocks = people.context_blocks(open_mentions)
    known = durable(extraction.extract_knowledge(blocks, model))
    offered = known.select("person_id", F.explode("tags").alias("tag"), F.lit(now).cast("long").alias("created_at"))
    memories = people.memory_rows(
        known.select(
            "person_id", F.explode("memories").alias("memory"), F.col("first_session").alias("session_id"),
            F.lit(now).cast("long").alias("created_at"),
        )
    )
    inserted = people.insert_tags(tags, offered)
    return {
        "tags": inserted,
        "memories": memories,
        "mentions": people.mark_processed(mentions, open_mentions),
        "metrics": people.pass_metrics(known, offered, inserted, memories, now),
    }


TAGS = "id string, person_id string, tag string, source string, created_at long"


def knowledge_stream(
    arriving: DataFrame, sessions: DataFrame, model, tables: str, checkpoint: str, every: str | None = None
):
    """The pass over each micro-batch of new mentions.  `every` repeats it, e.g.
    '60 seconds'; without it what is there is handled once.  Tags go to
    `tables`/offered_tags, from which `tag_stream` takes the new ones."""
    def handle(batch: DataFrame, number: int) -> None:
        out = knowledge_pass(durable(batch), sessions, None, model, number)
        _write(out["tags"], f"{tables}/offered_tags", number)
        _write(out["memories"], f"{tables}/person_key_memories", number)
        _write(out["mentions"], f"{tables}/person_mentions", number)

    return _started(arriving.writeStream.foreachBatch(handle), checkpoint, every)


def tag_stream(spark: SparkSession, tables: str, checkpoint: str, every: str | None = None):
    """Offered tags into `tables`/person_tags, each (person, tag) once; what is known is
    state per pair, and no stored tag is read again."""
    offered = spark.readStream.schema(TAGS).parquet(f"{tables}/offered_tags")
    new = first_seen(offered, ["person_id", "tag"], ["created_at", "id"])
    return _started(new.writeStream.foreachBatch(lambda batch, number: _write(batch, f"{tables}/person_tags", number)), checkpoint, every)


def _started(writer, checkpoint: str, every: str | None):
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def extraction_stream(
    prompts: DataFrame, model, tables: str, checkpoint: str, rounds: int = 2, most: int = 6,
    deadline: float | None = None, width: int = 4, every: str | None = None,
):
    """Results of arriving prompts (session_id, prompt).  What fails or hangs waits under
    `tables`/extraction_queue and is asked again with the next batch; each batch reads only
    the queue that the batch before left, so a batch's cost does not grow with history."""
    def handle(batch: DataFrame, number: int) -> None:
        folder = f"{tables}/extraction_queue"
        waiting = None
        if number:
            waiting = batch.sparkSession.read.schema(extraction.QUEUE).parquet(f"{folder}/batch={number - 1}")
        settled, rest = extraction.extraction_pass(batch, waiting, model, rounds, most, deadline, width)
        _write(settled, f"{tables}/extracted", number)
        _write(rest, folder, number)

    return _started(prompts.writeStream.foreachBatch(handle), checkpoint, every)
