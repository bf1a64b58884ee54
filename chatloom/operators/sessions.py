"""Sessions and chunks of chat messages.

Messages have the columns chat_id, sender, content, timestamp, type,
line_number; (timestamp, line_number) is their order inside a chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import constants as K
from chatloom.functions import text as T
from chatloom.operators.folds import fold_cuts
from chatloom.operators.ordered import Ordered, join_null_safe
from chatloom.session import durable

CHAT = ["chat_id"]
ORDER = ["timestamp", "line_number"]
SEGMENT = ["chat_id", "island", "cut_no"]


def _rows_with_gap(messages: DataFrame) -> Ordered:
    return Ordered.over(messages, CHAT, ORDER).previous({"__prev_ts": "timestamp"})


def _gap_over(seconds: int) -> Column:
    """True for the first row of a chat and after a pause of more than `seconds`."""
    gap = F.col("timestamp") - F.col("__prev_ts") > seconds
    return F.coalesce(gap, F.lit(True))


def gap_segments(messages: DataFrame, gap: int = K.SESSION_GAP_SECONDS) -> DataFrame:
    """Messages with (island, cut_no) when only pauses separate sessions."""
    rows = _rows_with_gap(messages)
    rows = rows.running_sum(_gap_over(gap).cast("long"), "island")
    return rows.result().withColumn("cut_no", F.lit(0).cast("long")).drop("__prev_ts")


def budget_segments(
    messages: DataFrame, gap: int = K.SESSION_GAP_SECONDS, budget: int = K.SESSION_TOKENS
) -> DataFrame:
    """Messages with (island, cut_no): a session ends at a pause, or before the
    message that would take it over the token budget."""
    tokens = T.token_estimate(F.col("content"))
    out = fold_cuts(
        _rows_with_gap(messages), _gap_over(gap),
        threshold=F.lit(budget) - tokens, add=tokens, reset=tokens, cap=budget + 1,
    )
    return out.select(*messages.columns, "island", "cut_no")


def session_rows(segments: DataFrame, summary: str = K.PLACEHOLDER_SUMMARY) -> DataFrame:
    """One row per session.  The id follows from the chat and the first message,
    so the same data always gives the same ids."""
    grouped = segments.groupBy(*SEGMENT).agg(
        F.min(F.struct(*ORDER)).alias("__first"),
        F.max("timestamp").alias("end_time"),
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(F.col("type") == "text").alias("text_count"),
    )
    return grouped.select(
        T.stable_id(F.col("chat_id"), F.col("__first.timestamp"), F.col("__first.line_number")).alias("id"),
        "chat_id",
        F.col("__first.timestamp").alias("start_time"),
        "end_time", "message_count",
        F.lit(summary).alias("summary"),
        "text_count",
        F.col("__first.line_number").alias("first_line"),
        "island", "cut_no",
    )


def label_messages(segments: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages with their session_id."""
    ids = sessions.select(*SEGMENT, F.col("id").alias("session_id"))
    return join_null_safe(segments, ids, SEGMENT).drop("island", "cut_no")


def trivial_summary() -> Column:
    """Fixed summary of a session with fewer than three text messages."""
    head, tail = K.BRIEF_SUMMARY.split("{n}")
    brief = F.concat(F.lit(head), F.col("message_count").cast("string"), F.lit(tail))
    return F.when(F.col("text_count") == 0, K.NO_TEXT_SUMMARY).when(F.col("text_count") < 3, brief)


def transcripts(segments: DataFrame) -> DataFrame:
    """Transcript of each session.  A session is bounded by its token budget, so
    the lines of one group are too."""
    line = F.concat(
        F.lit("["), T.iso_instant(F.col("timestamp")), F.lit("] "),
        F.col("sender"), F.lit(": "), F.col("content"),
    )
    grouped = segments.groupBy(*SEGMENT).agg(
        F.array_sort(F.collect_list(F.struct(*ORDER, line.alias("line")))).alias("__l"),
        F.count_if(F.col("type") == "text").alias("text_count"),
        F.count(F.lit(1)).alias("message_count"),
    )
    first = F.col("__l")[0]
    return grouped.select(
        T.stable_id(F.col("chat_id"), first["timestamp"], first["line_number"]).alias("session_id"),
        "chat_id", first["timestamp"].alias("start_time"),
        "message_count", "text_count",
        F.array_join(F.transform("__l", lambda x: x["line"]), "\n").alias("transcript"),
    )


# --- overlapping chunks ------------------------------------------------------

def _with_carry(rows: Ordered, overlap: int) -> Ordered:
    """UTF-16 length of the `overlap` messages before each message of the chat."""
    rows = rows.with_df(rows.df.withColumn("__len", T.utf16_length(F.coalesce("content", F.lit("")))))
    rows = rows.row_number("pos")
    if not rows.slice:
        near = Window.partitionBy(*CHAT).orderBy(*ORDER).rowsBetween(-overlap, -1)
        return rows.with_df(
            rows.df.withColumn("__carry_len", F.coalesce(F.sum("__len").over(near), F.lit(0)))
        )
    ahead = F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + overlap))
    carry = (
        rows.df.select("chat_id", ahead.alias("pos"), "__len")
        .groupBy("chat_id", "pos").agg(F.sum("__len").alias("__carry_len"))
    )
    joined = join_null_safe(rows.df, carry, ["chat_id", "pos"], "left")
    return rows.with_df(joined.withColumn("__carry_len", F.coalesce("__carry_len", F.lit(0))))


def chunk_members(
    messages: DataFrame,
    gap: int = K.CHUNK_GAP_SECONDS,
    budget: int = K.CHUNK_TOKENS,
    overlap: int = K.CHUNK_OVERLAP,
) -> DataFrame:
    """One row per (chunk, message).  A chunk is a segment of the chat together
    with the `overlap` messages before it, which is what carrying the last
    messages over amounts to.  Chunks are named by the position they start at."""
    rows = _with_carry(_rows_with_gap(messages), overlap)
    length = F.col("__len")
    tokens = F.ceil(length / 4)
    cut = fold_cuts(
        rows, _gap_over(gap),
        threshold=(F.lit(budget) - tokens) * 4, add=length,
        reset=F.col("__carry_len") + length, cap=budget * 4 + 1,
    ).select(*messages.columns, "pos", "island", "cut_no")
    if not rows.slice:
        # A row belongs to its own chunk and to those starting just after it.
        near = Window.partitionBy(*CHAT).orderBy("pos")
        new = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("pos")) == 1
        marked = cut.withColumn("__start", F.when(new, F.col("pos")))
        upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.max("__start").over(upto)
        later = F.collect_list("__start").over(near.rowsBetween(1, overlap))
        return (
            marked.withColumn("__own", own)
            .withColumn("__later", later)
            .withColumn("chunk_start", F.explode(F.concat(F.array("__own"), "__later")))
            .drop("island", "cut_no", "__start", "__own", "__later")
        )
    cut = durable(cut)
    starts = cut.groupBy(*SEGMENT).agg(F.min("pos").alias("chunk_start"))
    own = join_null_safe(cut, starts, SEGMENT).drop("island", "cut_no")
    carried_at = starts.filter("chunk_start > 1").select(
        "chat_id", "chunk_start",
        F.explode(
            F.sequence(F.greatest(F.lit(1), F.col("chunk_start") - overlap), F.col("chunk_start") - 1)
        ).alias("pos"),
    )
    carried = join_null_safe(cut.drop("island", "cut_no"), carried_at, ["chat_id", "pos"])
    return own.unionByName(carried)


def _chunk_columns(items: Column) -> list[Column]:
    """Text and counts of a chunk from its ordered message structs."""
    spoken = F.filter(items, lambda m: m["type"] != "system")
    return [
        F.array_join(
            F.transform(spoken, lambda m: F.concat(m["sender"], F.lit(": "), m["content"])), "\n"
        ).alias("content"),
        F.array_join(
            F.transform(
                items,
                lambda m: F.concat(
                    m["sender"], F.lit(" ["), T.clock(m["timestamp"]), F.lit("]: "), m["content"]
                ),
            ),
            "\n",
        ).alias("display_content"),
        F.element_at(items, 1)["timestamp"].alias("start_time"),
        F.element_at(items, -1)["timestamp"].alias("end_time"),
        F.size(items).cast("long").alias("message_count"),
        F.ceil(
            F.aggregate(items, F.lit(0).cast("long"), lambda a, m: a + T.utf16_length(m["content"])) / 4
        ).cast("long").alias("token_count"),
        F.array_distinct(F.transform(items, lambda m: m["sender"])).alias("participants"),
    ]


def _collected(members: DataFrame) -> DataFrame:
    item = F.struct("pos", "sender", "content", "timestamp", "type")
    return members.groupBy("chat_id", "chunk_start").agg(
        F.array_sort(F.collect_list(item)).alias("__m")
    )


def time_window_chunks(messages: DataFrame, **config) -> DataFrame:
    chunks = _collected(chunk_members(messages, **config))
    return chunks.select("chat_id", "chunk_start", *_chunk_columns(F.col("__m")))


def child_chunks(
    messages: DataFrame, window: int = K.CHILD_WINDOW, stride: int = K.CHILD_STRIDE, **config
) -> DataFrame:
    """Sliding windows over the messages of each chunk; the last one reaches its end."""
    chunks = _collected(chunk_members(messages, **config))
    return _slide(chunks, ["chat_id", "chunk_start"], window, stride)


def _slide(chunks: DataFrame, keys: list[str], window: int, stride: int) -> DataFrame:
    last = F.greatest(F.lit(0), F.ceil((F.size("__m") - window) / stride)).cast("int")
    slices = F.transform(
        F.sequence(F.lit(0), last), lambda k: F.slice("__m", k * stride + 1, F.lit(window))
    )
    children = chunks.select(*keys, F.posexplode(slices).alias("child_index", "__c"))
    return children.select(
        *keys, F.col("child_index").cast("long").alias("child_index"), *_chunk_columns(F.col("__c"))
    )


def message_chunks(messages: DataFrame) -> DataFrame:
    """Every message is a chunk of its own."""
    return messages.select(
        "chat_id", "timestamp", "line_number",
        F.concat("sender", F.lit(": "), "content").alias("content"),
        T.token_estimate(F.col("content")).alias("token_count"),
    )


def turn_segments(messages: DataFrame) -> DataFrame:
    """Messages with a turn number that grows whenever the sender changes."""
    rows = Ordered.over(messages, CHAT, ORDER).previous({"__prev_sender": "sender"})
    change = ~F.col("__prev_sender").eqNullSafe(F.col("sender"))
    return rows.running_sum(change.cast("long"), "turn_no").result().drop("__prev_sender")


def turn_rows(messages: DataFrame) -> DataFrame:
    return turn_segments(messages).groupBy("chat_id", "turn_no").agg(
        F.min("sender").alias("sender"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.count(F.lit(1)).alias("message_count"),
        F.sum(T.token_estimate(F.col("content"))).alias("token_count"),
    )


def sliding_chunks(
    messages: DataFrame, window: int = K.CHILD_WINDOW, stride: int = K.CHILD_STRIDE
) -> DataFrame:
    """Sliding windows over whole chats.  A message at position p lies in the
    windows that cover p, so each row is sent to those few windows only."""
    rows = Ordered.over(messages, CHAT, ORDER).row_number("pos").result()
    totals = rows.groupBy("chat_id").agg(F.max("pos").alias("__total"))
    rows = rows.join(totals, "chat_id")
    last = F.greatest(F.lit(0), F.ceil((F.col("__total") - window) / stride))
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - window) / stride))
    high = F.least(last, F.floor((F.col("pos") - 1) / stride))
    placed = rows.filter(low <= high).withColumn(
        "window_no", F.explode(F.sequence(low.cast("long"), high.cast("long")))
    )
    item = F.struct("pos", "sender", "content", "timestamp", "type")
    chunks = placed.groupBy("chat_id", "window_no").agg(
        F.array_sort(F.collect_list(item)).alias("__m")
    )
    return chunks.select("chat_id", "window_no", *_chunk_columns(F.col("__m")))
