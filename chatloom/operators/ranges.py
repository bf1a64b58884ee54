"""Messages inside session time ranges.

Joining on the chat alone would pair every message of a chat with every session
of it.  Sessions are put into time buckets of a width close to their own length
(a handful of widths), so each touches one or two buckets; a message looks into
one bucket per width that occurs.  The exact bounds are checked afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 1 h, 8 h, 2.7 d, 21 d, 171 d, 3.7 y, 30 y, and one bucket for all longer ones.
WIDTHS = [3600 * 8**k for k in range(7)] + [1 << 40]


def messages_in_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Pairs of a session (id as session_id) and a message of its chat whose time
    lies in [start_time, end_time].  Session columns get the prefix session_."""
    span = F.col("end_time") - F.col("start_time")
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        width = F.when(span <= w, F.lit(w)).otherwise(width)
    named = sessions.select(
        F.col("chat_id"), *[F.col(c).alias(f"session_{c}") for c in sessions.columns if c != "chat_id"],
        width.alias("__width"),
    ).filter("session_end_time >= session_start_time")
    first = F.floor(F.col("session_start_time") / F.col("__width"))
    last = F.floor(F.col("session_end_time") / F.col("__width"))
    ranges = named.withColumn("__bucket", F.explode(F.sequence(first, last)))
    # At most one array of eight numbers.
    used = sessions.select(width.alias("w")).agg(F.collect_set("w").alias("w")).scalar()
    placed = messages.withColumn("__width", F.explode(used)).withColumn(
        "__bucket", F.floor(F.col("timestamp") / F.col("__width"))
    )
    joined = placed.join(ranges, ["chat_id", "__width", "__bucket"])
    return joined.filter(
        F.col("timestamp").between(F.col("session_start_time"), F.col("session_end_time"))
    ).drop("__width", "__bucket")
