"""Streaming operators as queries: each reads its table as a stream, runs to the
end of what is there, and gives back what was written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.plans.fixtures import Tables
from chatloom.sources import exports
from chatloom.streaming import jobs


def work_folder(spark: SparkSession) -> str:
    """A new folder where the cluster keeps its checkpoints; a local session
    without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="chatloom-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def table_stream(t: Tables, name: str) -> DataFrame:
    schema = t.read(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def event_stream(t: Tables) -> DataFrame:
    return table_stream(t, "events").selectExpr(
        "CAST(user_id AS STRING) AS chat_id", "event_type AS sender", "props AS content",
        "unix_seconds(CAST(ts AS TIMESTAMP)) AS timestamp", "'text' AS type", "event_id AS line_number",
    )


# A time after all others, for the row that ends a stream.
END = 4_102_444_800


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """The stream, and a second source that `drained` uses to end it."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/end")
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{folder}/end"))


def drained(stream: DataFrame, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """Run an append stream over all there is; the sink is a table, not memory.  With
    `rows`, the table's rows as `with_end` saw them, a last batch of one row beyond all
    times moves the watermark past every open window and session, which are then told;
    what that row itself would open never closes."""
    def run():
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    if rows is not None:
        last = stream.sparkSession.range(1).select(
            *[F.lit(END if f.name == "timestamp" else None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        last.write.mode("append").parquet(f"{folder}/end")
        run()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _events(t: Tables, job) -> DataFrame:
    folder = work_folder(t.spark)
    events = event_stream(t)
    return drained(job(with_end(events, folder)), folder, events)


def stream_gap_sessions(t: Tables) -> DataFrame:
    return _events(t, jobs.gap_sessions)


def stream_budget_sessions(t: Tables) -> DataFrame:
    return _events(t, lambda rows: jobs.budget_sessions(rows, gap=86400, budget=40))


def stream_window_counts(t: Tables) -> DataFrame:
    return _events(t, jobs.window_counts)


def stream_sliding_counts(t: Tables) -> DataFrame:
    return _events(t, lambda rows: jobs.window_counts(rows, "1 hour", "15 minutes"))


def stream_distinct_messages(t: Tables) -> DataFrame:
    doubled = event_stream(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return drained(jobs.distinct_messages(doubled), work_folder(t.spark)).select(
        "chat_id", "timestamp", "sender", "content"
    )


def stream_pending_feed(t: Tables) -> DataFrame:
    extracted = table_stream(t, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS session_id",
        """array(named_struct('name', concat('Customer#', lpad(CAST(o_custkey * 2 AS STRING), 9, '0')),
           'type', 'person', 'context', o_orderpriority, 'sentiment', 'neutral',
           'is_participant', o_orderstatus = 'P')) AS mentioned_entities""",
    )
    return drained(jobs.pending_feed(extracted, t.people), work_folder(t.spark)).select(
        "session_id", "alias", "context"
    )


def stream_knowledge(t: Tables) -> DataFrame:
    from chatloom.plans.catalog import stub_model

    folder = work_folder(t.spark)
    arriving = table_stream(t, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS session_id", "CAST(o_custkey AS STRING) AS person_id",
        "o_orderpriority AS context", "o_orderstatus = 'F' AS processed",
    )
    jobs.knowledge_stream(arriving, t.order_sessions, stub_model, f"{folder}/tables", f"{folder}/state").awaitTermination()
    jobs.tag_stream(t.spark, f"{folder}/tables", f"{folder}/tag-state").awaitTermination()
    tags = t.spark.read.parquet(f"{folder}/tables/person_tags")
    return tags.select("person_id", "tag", "source")


def stream_import(t: Tables) -> DataFrame:
    """All chats as files, each of them twice, in two rounds of arrival."""
    folder = work_folder(t.spark)
    for place, chosen in (("a", "CAST(chat_id AS LONG) % 2 = 0"), ("b", "CAST(chat_id AS LONG) % 3 > 0"), ("c", "true")):
        exports.write_exports(t.messages.filter(chosen), f"{folder}/in/{place}", split=False)
        jobs.import_stream(t.spark, f"{folder}/in", f"{folder}/tables", f"{folder}/state").awaitTermination()
    chats = t.spark.read.parquet(f"{folder}/tables/chats")
    stored = t.spark.read.parquet(f"{folder}/tables/messages").groupBy(F.col("chat_id").alias("id")).agg(F.count(F.lit(1)).alias("stored"))
    return chats.join(stored, "id").select("name", "participant_count", "message_count", "first_message_at", "last_message_at", "stored")


STREAM_QUERIES = {
    f.__name__: f
    for f in [
        stream_gap_sessions, stream_budget_sessions, stream_window_counts, stream_sliding_counts,
        stream_distinct_messages, stream_pending_feed, stream_knowledge, stream_import,
    ]
}
