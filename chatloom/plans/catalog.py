"""Every operator as a query over the given tables."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import constants as K
from chatloom.functions import dates
from chatloom.functions import text as T
from chatloom.operators import (
    analytics, context, dashboard, extraction, imports, parsing, people, ranges, reads, search, sessions,
    stats, store, vectors,
)
from chatloom.operators.ordered import Ordered
from chatloom.plans.fixtures import RULES, Tables
from chatloom.session import spread
from chatloom.sources import exports
from chatloom.streaming.catalog import work_folder

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}

FORMATS = [*K.LINE_PATTERNS, *K.REGIONAL_PATTERNS]
NOW = 1767225600
# When the questions are asked: a Thursday, the first of January 1998, at noon.
ASKED_AT = 883656000
BUDGET = 256
EVENT_BUDGET = 40
CHUNK_BUDGET = 200


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- sources and parsing -------------------------------------------------------

def _export_lines(t: Tables, fmt: str) -> DataFrame:
    """All chats as export files, line by line."""
    rendered = exports.render_lines(t.messages, fmt)
    lines = rendered.select(
        F.col("chat_id").alias("file"), "timestamp", F.col("line_number").alias("turn"),
        F.posexplode(F.split("text", "\n")).alias("sub", "line"),
    )
    placed = Ordered.over(lines, ["file"], ["timestamp", "turn", "sub"]).row_number("line_number")
    return placed.result().select("file", "line_number", "line")


def _roundtrip(fmt: str) -> Query:
    def build(t: Tables) -> DataFrame:
        return parsing.parse_lines(_export_lines(t, fmt), regional=True).select(
            "chat_id", "sender", "content", "timestamp", "type"
        )

    return build


for _fmt in FORMATS:
    QUERIES[f"parse_roundtrip_{_fmt}"] = _roundtrip(_fmt)


def _noisy_lines(t: Tables) -> DataFrame:
    """Exports that open with lines of no message, and documents as files of no
    known format."""
    head = t.messages.filter("line_number = 0").select(
        F.col("chat_id").alias("file"), F.posexplode(F.split("content", "\n")).alias("sub", "line")
    )
    head = head.select("file", F.col("sub").cast("long").alias("sub"), "line")
    body = _export_lines(t, "android_br").select("file", (F.col("line_number") + 100000).alias("sub"), "line")
    rows = Ordered.over(head.unionByName(body), ["file"], ["sub"]).row_number("line_number").result()
    docs = t.read("documents").withColumn("file", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return rows.select("file", "line_number", "line").unionByName(exports.split_lines(docs, "file", "text"))


@query
def parse_stats(t):
    return parsing.parse_stats(_noisy_lines(t))


@query
def parse_errors(t):
    return parsing.parse_errors(_noisy_lines(t))


@query
def parse_participants(t):
    return parsing.participants(t.messages)


@query
def read_lines(t):
    return exports.split_lines(t.read("documents"), "doc_id", "text")


@query
def export_files(t):
    """All chats written as files and read back from them."""
    folder = work_folder(t.spark)
    exports.write_exports(t.messages, folder, "android_es")
    return exports.read_exports(t.spark, folder, regional=True).select("chat_id", "sender", "content", "timestamp", "type", "line_number")


@query
def file_lines(t):
    """Lines of all export files, by the chat that their folder names."""
    folder = work_folder(t.spark)
    exports.write_exports(t.messages, folder)
    return exports.read_lines(t.spark, folder).groupBy(exports.chat_of(F.col("file")).alias("chat_id")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("letters"))


@query
def file_roots(t):
    """Hash trees of all export files, with few children per node."""
    folder = work_folder(t.spark)
    exports.write_exports(t.messages, folder, split=False)
    found = exports.file_roots(t.spark, f"{folder}/*/*.txt", fan=3)
    return found.select(exports.chat_of(F.col("file")).alias("chat_id"), "size", "root")


@query
def json_chats(t):
    """All chats as JSON documents and back."""
    folder = work_folder(t.spark)
    exports.write_json_chats(t.messages, folder)
    return exports.read_json_chats(t.spark, f"{folder}/*/*.txt").select("chat_id", "sender", "content", "timestamp", "type", "line_number")


@query
def import_chain(t):
    """Export files to chats, sessions, entities, links and inbox: what each chat brought."""
    folder = work_folder(t.spark)
    exports.write_exports(t.messages, folder)
    known = t.read("supplier").select(F.concat(F.lit("PESSOA "), F.format_string("%02X", F.col("s_suppkey") % 200)).alias("name")).distinct()
    known = known.select(F.lower("name").alias("id"), "name", F.lit(1).cast("long").alias("message_count"))
    made = imports.import_chats(exports.read_exports(t.spark, folder), known, moody_model, gap_only=True, rounds=2, most=4, deadline=3.0, width=16)
    of = made["sessions"].select(F.col("id").alias("session_id"), "chat_id")
    per = lambda name, table: table.join(of, "session_id").groupBy("chat_id").agg(F.count(F.lit(1)).alias(name))
    out = made["chats"].select(F.col("id").alias("chat_id"), "participant_count", "message_count")
    waiting = made["sessions"].groupBy("chat_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("summary").startswith("len ")).alias("told"))
    for part in (waiting, per("entities", made["entities"]), per("mentions", made["mentions"]), per("pending", made["pending"])):
        out = out.join(part, "chat_id", "left")
    return out.na.fill(0, ["entities", "mentions", "pending"])


@query
def session_updates(t):
    """Sessions and entities after results came in twice, on top of stored entities."""
    results = t.extracted.withColumn("summary", F.concat(F.lit("new "), "session_id"))
    stored = people.entity_rows(results.filter("CAST(session_id AS LONG) % 3 = 0"))
    rows, entities = store.update_sessions(t.order_sessions.filter("CAST(id AS LONG) % 2 = 0"), stored, results.unionByName(results))
    counts = entities.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("entities"), F.max("normalized_name").alias("name"))
    return rows.join(counts, "id", "full_outer").select("id", "summary", "entities", "name")


@query
def detect_formats(t):
    rows = [_export_lines(t, f).withColumn("file", F.concat(F.lit(f + ":"), "file")) for f in FORMATS]
    lines = rows[0]
    for r in rows[1:]:
        lines = lines.unionByName(r)
    return parsing.detect_formats(lines, regional=True)


@query
def message_type(t):
    return spread(t.doc_messages.select("line_number", "content", "sender")).select(
        F.col("line_number").alias("doc_id"), T.message_type(F.col("content"), F.col("sender")).alias("type")
    )


@query
def chat_names(t):
    path = F.concat(F.lit("file:/exports/Conversa%20"), "source", F.lit("+v1."), "lang", F.lit(".txt"))
    return t.read("documents").select("doc_id", T.chat_name(path).alias("name"))


@query
def text_measures(t):
    c = F.col("content")
    return t.doc_messages.select(
        F.col("line_number").alias("doc_id"), T.utf16_length(c).alias("length"), T.token_estimate(c).alias("tokens")
    )


@query
def keyword_cleaning(t):
    return t.doc_messages.select(
        F.col("line_number").alias("doc_id"), T.clean_keyword(F.col("content")).alias("cleaned"),
        F.sha2(T.clean_keyword(F.col("content"), False), 256).alias("joined"),
    )


# --- stores ----------------------------------------------------------------------

@query
def insert_or_ignore(t):
    again = t.messages.withColumn("line_number", F.col("line_number") + 1000)
    stored = t.messages.filter("sender = 'assistant'")
    return store.insert_messages(stored, t.messages.unionByName(again))


@query
def file_hash_dedup(t):
    files = t.read("documents").select(
        F.format_string("%012d", "doc_id").alias("file"), store.file_hash(F.col("text")).alias("file_hash")
    )
    known = t.read("benchmark").select(store.file_hash(F.col("text")).alias("file_hash"))
    return store.new_files(files, known)


@query
def chat_rows(t):
    return t.chats.drop("file_hash")


@query
def refresh_chats(t):
    spoken = t.messages.filter("type <> 'system'")
    return store.refresh_chats(t.chats, spoken).select(
        "id", "participant_count", "message_count", "first_message_at", "last_message_at"
    )


@query
def update_summaries(t):
    updates = t.read("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("session_id")).agg(
        F.max("l_returnflag").alias("summary")
    )
    return store.update_summaries(t.order_sessions, updates)


@query
def upsert_latest(t):
    rows = t.read("events").select(
        F.col("user_id").cast("string").alias("contact_id"), F.col("event_type").alias("block_index"),
        F.col("props").alias("summary_text"), F.col("event_id").alias("version"),
    )
    return store.upsert(rows.filter("block_index <> 'error'"), rows, ["contact_id", "block_index"], ["version"])


@query
def upsert_profiles(t):
    rows = t.read("orders").select(
        F.lit(None).cast("string").alias("id"), F.col("o_custkey").cast("string").alias("contact_id"),
        F.when(F.col("o_orderstatus") == "F", "m1").alias("model_used"),
        F.col("o_orderpriority").alias("profile_text"), F.col("o_orderkey").alias("updated_at"),
    )
    return store.upsert_profiles(rows.filter("false"), rows)


@query
def cascade_delete(t):
    doomed = t.read("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("id"))
    out = store.delete_chats(
        {
            "chats": t.people, "messages": t.event_messages, "sessions": t.order_sessions,
            "entities": t.entities, "person_mentions": t.mentions, "person_key_memories": t.memories,
        },
        doomed,
    )
    key = {"chats": "id", "messages": "line_number", "sessions": "id", "entities": "id",
           "person_mentions": "session_id", "person_key_memories": "session_id"}
    counted = [
        df.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
            F.sum(F.col(key[name]).cast("long")).alias("keys"),
        )
        for name, df in out.items()
    ]
    rows = counted[0]
    for c in counted[1:]:
        rows = rows.unionByName(c)
    return rows


@query
def retention(t):
    return store.expired_chats(t.chats, 365, NOW)


@query
def json_columns(t):
    packed = t.chats.withColumn("metadata", store.encode_metadata(["name", "message_count"]))
    back = store.decode_metadata("metadata", "name string, message_count int")
    return packed.select("id", "metadata", back["message_count"].alias("decoded_count"))


# --- sessions and chunks -----------------------------------------------------------

SESSION_COLUMNS = ["id", "chat_id", "start_time", "end_time", "message_count", "text_count"]


@query
def gap_sessions(t):
    return sessions.session_rows(sessions.gap_segments(t.messages)).select(SESSION_COLUMNS)


@query
def gap_sessions_events(t):
    return sessions.session_rows(sessions.gap_segments(t.event_messages)).select(SESSION_COLUMNS)


@query
def budget_sessions(t):
    return sessions.session_rows(sessions.budget_segments(t.messages, budget=BUDGET)).select(SESSION_COLUMNS)


@query
def budget_sessions_events(t):
    return sessions.session_rows(
        sessions.budget_segments(t.event_messages, gap=86400, budget=EVENT_BUDGET)
    ).select(SESSION_COLUMNS)


@query
def sub_sessions(t):
    return sessions.session_rows(
        sessions.budget_segments(t.messages, budget=K.SUBSESSION_TOKENS)
    ).select(SESSION_COLUMNS)


@query
def labelled_messages(t):
    segments = sessions.budget_segments(t.messages, budget=BUDGET)
    labelled = sessions.label_messages(segments, sessions.session_rows(segments))
    return labelled.select("session_id", "chat_id", "timestamp", "line_number")


@query
def transcripts(t):
    return sessions.transcripts(sessions.budget_segments(t.messages)).select(
        "session_id", "chat_id", "message_count", "transcript"
    )


@query
def trivial_sessions(t):
    rows = sessions.session_rows(sessions.gap_segments(t.messages))
    return rows.select("id", sessions.trivial_summary().alias("summary")).filter("summary is not null")


@query
def time_window_chunks(t):
    return sessions.time_window_chunks(t.messages, budget=CHUNK_BUDGET).withColumn(
        "participants", F.array_join("participants", ", ")
    )


@query
def parent_child_chunks(t):
    children = sessions.child_chunks(t.event_messages, gap=86400, budget=EVENT_BUDGET * 4)
    return children.select(
        "chat_id", "chunk_start", "child_index", F.sha2("content", 256).alias("content"), "start_time",
        "end_time", "message_count", "token_count",
    )


@query
def sliding_chunks(t):
    return sessions.sliding_chunks(t.event_messages).select(
        "chat_id", "window_no", "start_time", "end_time", "message_count", "token_count",
        F.sha2("display_content", 256).alias("display"),
    )


@query
def turn_chunks(t):
    return sessions.turn_rows(t.event_messages)


@query
def message_chunks(t):
    return sessions.message_chunks(t.messages)


# --- reads -------------------------------------------------------------------------

@query
def all_chats(t):
    return reads.all_chats(t.chats).select("id", "message_count", "last_message_at")


@query
def chats_by_id(t):
    wanted = t.messages.filter("sender = 'system'").select(F.col("chat_id").alias("id"))
    return reads.by_ids(t.chats, wanted).select("id", "message_count")


@query
def chat_pages(t):
    return reads.chat_pages(t.event_messages, limit=20, offset=10).select("chat_id", "pos", "timestamp", "line_number")


@query
def counts_per_chat(t):
    return reads.counts_per_chat(t.messages, "messages").join(
        reads.counts_per_chat(sessions.session_rows(sessions.gap_segments(t.messages)), "sessions"), "chat_id"
    )


@query
def chat_participants(t):
    return reads.chat_participants(t.messages)


@query
def entities_by_chat(t):
    return reads.entities_by_chat(t.entities, t.order_sessions).groupBy("chat_id", "normalized_name").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def people_by_activity(t):
    return reads.people_by_activity(t.people)


@query
def person_tags(t):
    wanted = t.people.filter("message_count > 10").select("id")
    return reads.person_items(t.tags, wanted, "tag")


@query
def person_memories(t):
    """The wanted people's memories, oldest first, as rows."""
    wanted = t.people.filter("message_count > 10").select("id")
    return reads.person_items(people.memory_rows(t.memories), wanted, "memory")


@query
def chat_sessions(t):
    """The sessions of one chat, the one with the smallest number."""
    first = t.order_sessions.agg(F.min(F.col("chat_id").cast("long"))).first()[0]
    return reads.chat_sessions(t.order_sessions, str(first)).select("id", "chat_id", "start_time", "end_time", "summary")


@query
def entities_by_chat(t):
    return reads.entities_by_chat(t.entities, t.order_sessions).select("id", "session_id", "chat_id", "normalized_name", "type")


@query
def session_range_join(t):
    rows = sessions.session_rows(sessions.budget_segments(t.messages, budget=BUDGET))
    return ranges.messages_in_sessions(t.messages, rows).select(
        "session_id", "chat_id", "timestamp", "line_number"
    )


@query
def filtered_messages(t):
    chats = t.chats.filter("participant_count = 3").select("id")
    senders = t.messages.filter("type = 'system'").select("sender")
    return reads.filtered(t.messages, chats, senders, 1704067200, NOW)


# --- search ------------------------------------------------------------------------

@query
def search_vocabulary(t):
    return search.vocabulary(t.doc_messages, ["line_number"], ["sender", "content"])


@query
def search_pivots(t):
    return search.factual_pivots(t.queries, t.messages)


@query
def search_factual(t):
    return search.search_factual(t.queries, t.messages, window=2).select(
        "query_id", "rank", "chat_id", "timestamp", "line_number"
    )


@query
def search_documents(t):
    """Ranking over the longest texts."""
    keys = ["line_number"]
    docs = search.tokenized(t.doc_messages, keys, ["content"])
    return search.top_k(
        search.bm25(docs, keys, search.phrases(t.queries)), ["query_id"], [F.desc("score"), "line_number"], 10
    )


def _document_queries(t: Tables) -> DataFrame:
    """One query per document, of its own words: a phrase of one to four of them, the last
    one cut short, and a single prefix."""
    words = spread(t.read("documents")).select("doc_id", T.search_tokens(F.coalesce("text", F.lit(""))).alias("w"))
    at = (F.col("doc_id") * 7 % F.size("w") + 1).cast("int")
    phrase = F.slice("w", at, (1 + F.col("doc_id") % 4).cast("int"))
    cut = F.substring(F.array_join(phrase, " "), 1, 24)
    return words.filter(F.size("w") > 0).select(
        F.col("doc_id").cast("string").alias("query_id"), F.array(cut, F.substring(F.element_at("w", 1), 1, 6)).alias("keywords"))


@query
def search_many(t):
    """As many phrase queries as there are documents, over all messages."""
    docs = search.tokenized(t.messages, search.MESSAGE_KEY, ["sender", "content"])
    scored = search.bm25(docs, search.MESSAGE_KEY, search.phrases(_document_queries(t)), most=3)
    return search.top_k(scored, ["query_id"], [F.desc("score"), *search.MESSAGE_KEY], 3)


@query
def search_narrative(t):
    return search.search_narrative(t.queries, t.order_sessions)


@query
def search_recent(t):
    return search.search_recent(t.queries, t.order_sessions)


@query
def search_aggregation(t):
    return search.search_aggregation(t.queries, t.entities, t.order_sessions)


@query
def entity_hop(t):
    return search.entity_hop(t.queries, t.entities, t.order_sessions).select(
        "query_id", F.array_join("keywords", "|").alias("keywords")
    )


def _routed(t: Tables, hop: bool = True) -> DataFrame:
    return search.routed_search(t.queries, t.messages, t.order_sessions, t.entities, t.chats, hop=hop)


@query
def routed_search(t):
    return _routed(t).select("query_id", "rank", "kind", "chat_id", "chat_name", "score", "start_time", "sender", "content")


def _requests(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = sessions.session_rows(sessions.gap_segments(t.messages))
    return rows.select(
        F.concat(F.lit("r-"), "id").alias("request_id"), F.col("id").alias("session_id"),
        F.when(F.col("message_count") > 2, "THE ").otherwise("eau").alias("snippet"),
    ), rows


@query
def neighbours(t):
    requests, rows = _requests(t)
    return search.neighbours(requests, rows, t.messages, limit=1).drop("sender", "content")


@query
def alias_match(t):
    asked = t.read("customer").groupBy("c_mktsegment").agg(F.max("c_name").alias("alias")).select(
        F.col("c_mktsegment").alias("query_id"), F.expr("substring(alias, 1, length(alias) - 2)").alias("alias")
    )
    aliases = t.people.select(F.col("id").alias("person_id"), F.regexp_replace("name", "#", " ").alias("alias"))
    asked = asked.withColumn("alias", F.regexp_replace("alias", "#", " "))
    return search.match_aliases(asked, aliases, t.people)


@query
def highlight(t):
    return t.messages.select(
        "chat_id", "line_number", T.highlight(F.col("content"), F.lit(" heit the étre ")).alias("marked")
    )


@query
def snippet_lines(t):
    chunks = sessions.time_window_chunks(t.messages, budget=CHUNK_BUDGET)
    return search.snippet_lines(chunks, ["chat_id", "chunk_start"], "display_content")


@query
def suggestions(t):
    prefixes = t.read("documents").select(F.substring("text", 1, 2).alias("prefix"))
    return search.suggest(prefixes, search.vocabulary(t.doc_messages, ["line_number"], ["content"]))


# --- people ------------------------------------------------------------------------

@query
def sender_counts(t):
    return people.sender_counts(t.event_messages)


@query
def people_upsert(t):
    known = t.read("customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.upper("c_mktsegment").alias("seg"),
        F.upper("c_name").alias("name"), F.lit(1).cast("long").alias("message_count"),
    ).drop("seg")
    spoken = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("New "), "c_name")).otherwise(F.col("c_name")).alias("sender"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
    )
    return people.merge_senders(known, spoken)


@query
def entity_rows(t):
    return people.entity_rows(t.extracted)


@query
def mention_routing(t):
    return people.route_mentions(people.entity_rows(t.extracted), t.people).select(
        "session_id", "name", "context", "person_id"
    )


@query
def link_mentions(t):
    routed = people.route_mentions(people.entity_rows(t.extracted), t.people)
    stored = t.mentions.filter("processed")
    return people.linked_mentions(routed, stored)


@query
def pending_inbox(t):
    routed = people.route_mentions(people.entity_rows(t.extracted), t.people)
    return people.inbox(people.pending_mentions(routed, 5))


@query
def mention_clones(t):
    chosen = t.decisions.select(F.col("mention_id").alias("id"))
    return people.clones(t.pending, chosen).select("id", "alias")


def _resolved(name: str) -> Query:
    def build(t: Tables) -> DataFrame:
        out = people.resolve_mentions(t.pending, t.decisions)[name]
        return out.drop("color") if name == "people" else out

    return build


for _name in ["people", "aliases", "mentions", "pending", "errors"]:
    QUERIES[f"resolve_{_name}"] = _resolved(_name)


@query
def person_colors(t):
    return t.people.select("id", people.person_color(F.col("name")).alias("color"))


@query
def tags_insert(t):
    stored = t.tags.filter("tag = '5-low'")
    return people.insert_tags(stored, t.tags)


@query
def memories_insert(t):
    return people.memory_rows(t.memories)


@query
def unprocessed_mentions(t):
    sessions_kept = t.order_sessions.filter("summary <> '2-HIGH'")
    return people.unprocessed_mentions(t.mentions, sessions_kept)


@query
def context_blocks(t):
    kept = t.order_sessions.filter("summary <> '2-HIGH'")
    return people.context_blocks(people.unprocessed_mentions(t.mentions, kept), size=4)


@query
def mark_processed(t):
    return people.mark_processed(t.mentions, t.mentions.filter("context = '5-LOW'"))


# --- extraction ----------------------------------------------------------------------

def stub_model(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a text model."""
    return [
        json.dumps({"summary": f"len {len(p)}", "mentioned_entities": [], "tags": [f"t{len(p) % 7}"], "memories": [f"m {len(p)}"]})
        for p in prompts
    ]


def stub_batch_model(prompts: list[str]) -> list[str]:
    """Answers for the first session of each batch only."""
    return [json.dumps({"results": [{"summary": f"len {len(p)}", "mentioned_entities": []}]}) for p in prompts]


@query
def json_recovery(t):
    found = F.from_json(extraction.recover_json(F.col("answer")), extraction.RESULT)
    status = F.when(extraction.recover_json(F.col("answer")).isNull(), "failed").otherwise("ok")
    return t.answers.select("session_id", status.alias("status"), extraction.with_defaults(found, status).alias("r")).select(
        "session_id", "status", "r.summary", F.size("r.mentioned_entities").cast("long").alias("entities")
    )


@query
def classify_queries(t):
    return extraction.validated(extraction.classify_queries(t.questions, RULES)).withColumn(
        "keywords", F.array_join("keywords", "|")
    )


@query
def expand_keywords(t):
    asked = extraction.classify_queries(t.questions, RULES)
    return extraction.expand_keywords(asked, t.synonyms).select(
        "query_id", F.array_join("keywords", "|").alias("keywords")
    )


@query
def question_dates(t):
    """Each question asked at a time of its own."""
    now = F.lit(ASKED_AT) - F.col("query_id").cast("long") * 40009
    return dates.with_date_range(t.questions, F.col("text"), now).select("query_id", "date_from", "date_to")


@query
def ask_questions(t):
    return context.ask_questions(t.questions, ASKED_AT, RULES, t.synonyms, t.messages, t.order_sessions, t.entities, t.chats)


@query
def extract_sessions(t):
    told = sessions.transcripts(sessions.gap_segments(t.messages))
    return extraction.extract_sessions(told, stub_model).select("session_id", "summary", "status", "attempts")


def moody_model(prompts: list[str]) -> list[str]:
    """Stand-in that tells people, and by the transcript's hash raises once, answers without
    JSON three times or always, hangs once or always."""
    out = []
    for p in prompts:
        told = p.removeprefix(extraction.SESSION_TASK).split(extraction.NOTE)[0]
        failures = p.count(extraction.NOTE)
        mark = hashlib.md5(told.encode()).hexdigest()
        if mark[0] == "0" and not failures:
            raise ValueError("no connection")
        if mark.startswith("40") or (mark.startswith("20") and not failures):
            time.sleep(30)
        if mark[0] == "3" or (mark[0] == "1" and failures < 3):
            out.append("I cannot do that")
            continue
        person = {"name": f"Pessoa {mark[1:3]}", "type": "person", "context": mark[:4], "is_participant": mark[0] == "5"}
        out.append(json.dumps({"summary": f"len {len(told)}", "mentioned_entities": [person] * (1 + int(mark[3] == "7"))}))
    return out


def _moody_results(t: Tables) -> DataFrame:
    told = sessions.transcripts(sessions.gap_segments(t.messages))
    return extraction.extract_until_settled(told, moody_model, rounds=2, most=4, deadline=3.0, width=16)


@query
def extraction_queue(t):
    """Every session until it is answered or given up."""
    return _moody_results(t).select(
        "session_id", "summary", F.size("mentioned_entities").cast("long").alias("entities"), "attempts", "status", F.col("pass").alias("pass_no"))


@query
def batch_extract(t):
    told = sessions.transcripts(sessions.gap_segments(t.messages))
    packed = extraction.pack_sessions(told)
    answers = extraction.ask(packed, "prompt", stub_batch_model, 3)
    return extraction.unpack_sessions(answers).select("session_id", "summary", "status")


@query
def extraction_timing(t):
    told = sessions.transcripts(sessions.gap_segments(t.messages))
    return extraction.extraction_timing(extraction.extract_sessions(told, stub_model)).select(
        "sessions", "model_sessions"
    )


@query
def person_knowledge(t):
    blocks = people.context_blocks(people.unprocessed_mentions(t.mentions, t.order_sessions))
    known = extraction.extract_knowledge(blocks, stub_model)
    return known.select(
        "person_id", "part", "first_session", F.array_join("tags", "|").alias("tags"),
        F.array_join("memories", "|").alias("memories"), "status",
    )


@query
def knowledge_metrics(t):
    from chatloom.streaming.jobs import knowledge_pass

    return knowledge_pass(t.mentions, t.order_sessions, None, stub_model)["metrics"]


# --- statistics ------------------------------------------------------------------------

@query
def term_stats(t):
    return stats.term_stats(t.doc_messages).drop("first_line")


@query
def sender_terms(t):
    return stats.sender_terms(t.messages).drop("first_place")


@query
def term_samples(t):
    terms = stats.ranked_terms(stats.term_stats(t.doc_messages), 3)
    return stats.sample_messages(t.doc_messages, terms).withColumn("sample", F.sha2("sample", 256))


@query
def cooccurrence(t):
    return stats.cooccurrences(t.doc_messages, stats.term_stats(t.doc_messages)).select(
        "chat_id", "term_a", "term_b", "count"
    )


def _topics(t: Tables) -> DataFrame:
    """A topic for each vector: the ten labels stand for the ten topics."""
    rows = t.read("embeddings")
    assigned = vectors.nearest_centroid(rows, vectors.centroids(rows))
    names = F.array(*[F.lit(k) for k, _, _ in K.TOPICS])
    return assigned.select(
        "vec_id", F.concat(F.lit("src"), F.col("label").cast("string")).alias("chat_id"),
        F.try_element_at(names, (F.col("topic") + 1).cast("int")).alias("topic"), "score",
    )


@query
def topic_share(t):
    return stats.topic_share(_topics(t), "chat_id")


@query
def profile_facts(t):
    names = t.doc_messages.groupBy("chat_id").agg(F.upper(F.first("chat_id")).alias("contact_name"))
    return stats.profile_facts(t.doc_messages, names, _topics(t))


# --- vectors -----------------------------------------------------------------------------

@query
def l2_normalize(t):
    scaled = t.read("embeddings").withColumn("embedding", F.transform("embedding", lambda x: x * (F.col("label") * 2)))
    return vectors.normalized(scaled).select("vec_id", F.posexplode("embedding").alias("place", "x")).select(
        "vec_id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x")
    )


@query
def centroids(t):
    return vectors.centroids(t.read("embeddings")).select(
        "label", F.posexplode("embedding").alias("place", "x")
    ).select("label", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query
def label_similarity(t):
    rows = t.read("embeddings")
    centers = vectors.centroids(rows).select("label", F.col("embedding").alias("center"))
    return vectors.similarity_pairs(rows.join(centers, "label"), "embedding", "center").select(
        "vec_id", F.round("similarity", 6).alias("similarity")
    )


@query
def nearest_centroid(t):
    rows = t.read("embeddings")
    found = vectors.nearest_centroid(rows, vectors.centroids(rows))
    return found.select("vec_id", "topic", F.round("score", 6).alias("score"))


def _label_queries(t: Tables) -> DataFrame:
    return vectors.centroids(t.read("embeddings")).select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("query_id"), "embedding"
    )


@query
def knn(t):
    near = vectors.knn(_label_queries(t), t.read("embeddings"), 10)
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query
def hybrid_search(t):
    """Vectors and texts with the same number are one item."""
    near = vectors.knn(_label_queries(t), t.read("embeddings"), 10)
    asked = t.queries.select(
        F.concat(F.lit("label-"), (F.substring("query_id", 2, 2).cast("int") - 1).cast("string")).alias("query_id"), "keywords"
    )
    docs = search.tokenized(t.read("documents"), ["doc_id"], ["text"])
    scored = search.bm25(docs, ["doc_id"], search.phrases(asked))
    found = search.top_k(scored, ["query_id"], [F.desc("score"), "doc_id"], 10).select(
        "query_id", F.col("doc_id").alias("vec_id"), (-F.col("score")).alias("rank_value")
    )
    mixed = vectors.hybrid(near, found, "vec_id", 10)
    return mixed.select("query_id", "vec_id", F.round("combined", 6).alias("combined"), "rank")


@query
def relevant_chunks(t):
    rows = t.read("embeddings").select(
        F.col("label").alias("person_id"), F.col("vec_id").alias("chunk_id"), "embedding"
    )
    owners = vectors.centroids(rows, "person_id").select("person_id", F.col("embedding").alias("profile"))
    found = vectors.relevant_chunks(owners, rows, 5)
    return found.select("person_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


# --- answering context ---------------------------------------------------------------------

@query
def context_prompts(t):
    return context.prompts(t.queries, _routed(t, hop=False))


@query
def fixed_answers(t):
    return context.fixed_answers(t.queries, _routed(t, hop=False))


@query
def fallback_answers(t):
    return context.fallback_answers(_routed(t, hop=False))


@query
def citations(t):
    return context.citations(_routed(t, hop=False)).drop("text")


# --- dashboard -------------------------------------------------------------------------------

@query
def home_totals(t):
    return dashboard.home_totals(t.chats, t.people, t.tags, t.memories)


@query
def featured_people(t):
    tags = people.insert_tags(None, t.tags)
    return dashboard.featured_people(t.people, tags)


@query
def recent_chats(t):
    return dashboard.recent_chats(t.chats)


@query
def relative_time(t):
    return t.messages.select(
        "chat_id", "line_number", T.relative_time(F.col("timestamp"), F.lit(1705000000 + 604800)).alias("label")
    )


@query
def person_cards(t):
    tags = people.insert_tags(None, t.tags)
    memories = people.memory_rows(t.memories)
    return dashboard.person_cards(t.people, tags, memories, page=5).withColumn("items", F.array_join("items", "; "))


@query
def node_weights(t):
    return dashboard.node_weights(t.people)


@query
def pivot_flags(t):
    rows = t.messages.select(
        "chat_id", "line_number", F.split_part("content", F.lit(" "), F.lit(1)).alias("content"),
        F.col("content").alias("context"),
    )
    return dashboard.pivot_flags(rows).select("chat_id", "line_number", "is_pivot")


# --- analytics ---------------------------------------------------------------------------------

@query
def activity(t):
    return analytics.activity(t.event_messages)


@query
def activity_rollup(t):
    return analytics.activity_rollup(t.event_messages)


@query
def relations(t):
    return analytics.relations(t.memberships)


@query
def all_relations(t):
    return reads.all_relations(analytics.relations(t.memberships))


@query
def strong_relations(t):
    """The graph without its weak half: edges of at least a strength, with the people's degrees."""
    edges = analytics.relations(t.memberships)
    return analytics.strong_edges(edges, 0.5)


@query
def graph_edges(t):
    return dashboard.graph_edges(analytics.relations(t.memberships))


@query
def window_relations(t):
    return analytics.relations(analytics.window_memberships(t.event_messages, 86400))


@query
def name_variants(t):
    return analytics.name_variants(t.read("supplier"), "s_name")


@query
def label_variants(t):
    """Part names, few of which are alike, by their letters without blanks."""
    return analytics.name_variants(t.read("part").select(F.replace("p_name", F.lit(" ")).alias("name")))


@query
def relations_in_period(t):
    """Suppliers that met in orders of 1995 and 1996, both from the same two regions."""
    orders = t.read("orders").selectExpr("o_orderkey AS context_id", "year(o_orderdate) * 12 + month(o_orderdate) - 1 AS bucket")
    met = t.read("lineitem").selectExpr("l_orderkey AS context_id", "l_suppkey AS person_id").join(orders, "context_id")
    tags = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey AS person_id", "n_regionkey AS tag")
    return analytics.relations_in_period(analytics.running_relations(met), 1995 * 12, 1996 * 12 + 11, tags.filter("tag in (1, 3)"))


@query
def event_timeline(t):
    """Each source is an event, each question about it a mention at a time of its own."""
    told = t.questions.join(t.read("documents").select(F.col("doc_id").cast("string").alias("query_id"), "source"), "query_id")
    told = told.withColumn("at", F.lit(ASKED_AT) - F.col("query_id").cast("long") * 40009)
    return analytics.event_timeline(told, "source", "text", "at").select(
        "event", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "mentions")


@query
def inbox_after_changes(t):
    """Mentions are put, some of them removed a day later; a customer's inbox is cleared by
    each urgent order."""
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    orders = t.read("orders")
    put = orders.select(
        F.lit("put").alias("op"), F.col("o_custkey").alias("chat_id"), (F.col("o_orderkey") % 50).alias("mention"), at.alias("moment"),
        F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("alias"))
    removed = put.filter("line % 3 = 0").withColumns({"op": F.lit("delete"), "moment": F.col("moment") + 86400})
    cleared = put.filter("alias = '1-URGENT' and line % 7 = 0").withColumns({"op": F.lit("clear"), "mention": F.lit(None).cast("long")})
    return store.replay(put.unionByName(removed).unionByName(cleared), ["mention"], ["moment", "line"], ["chat_id"])


@query
def profile_tables_after_changes(t):
    """Facts, block summaries and profiles as one log: kind and contact are the scope."""
    parts = t.read("lineitem")
    rows = parts.selectExpr(
        "CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 'clear' WHEN l_returnflag = 'R' THEN 'delete' ELSE 'put' END AS op",
        "element_at(array('fact', 'block', 'profile'), CAST(l_linenumber % 3 + 1 AS INT)) AS kind",
        "l_suppkey AS contact_id", "l_linenumber AS place", "l_orderkey AS moment", "CAST(CAST(l_shipdate AS DATE) AS STRING) AS text")
    return store.replay(rows, ["place"], ["moment"], ["kind", "contact_id"])


@query
def mean_extraction(t):
    """Calls and attempts per status; the milliseconds differ from run to run and must only be there."""
    done = _moody_results(t)
    return done.groupBy("status").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("attempts").alias("attempts"),
        (F.min(F.when(F.col("attempts") > 0, F.col("elapsed_ms"))) > 0).alias("took_time"))


@query
def text_embeddings(t):
    """The embedding helper with a small model: shares of five letters, averaged over pieces."""
    model = lambda texts: [[x.count(c) for c in "aeiou"] for x in texts]
    rows = vectors.embed(t.read("documents").select("doc_id", "text"), "text", model, 5, piece=10**9)
    return rows.select("doc_id", *[F.round(F.get("embedding", F.lit(i)), 6).alias(c) for i, c in enumerate("aeiou")])


@query
def facts_by_evidence(t):
    facts = t.read("part").selectExpr("p_brand AS contact_id", "p_name AS text", "CAST(p_size AS BIGINT) AS evidence")
    ordered = reads.facts_by_evidence(facts)
    return ordered.select("contact_id", "evidence", "text")


@query
def unknown_formats(t):
    files = t.read("documents").selectExpr("CAST(doc_id AS STRING) AS file", "CASE lang WHEN 'en' THEN 'android_en' WHEN 'de' THEN 'ios_en' ELSE lang END AS format")
    return parsing.unknown_formats(files)


@query
def session_topics(t):
    told = sessions.transcripts(sessions.gap_segments(t.messages))
    return stats.session_topics(told, 0.3).select("session_id", "topic", "label", F.round("score", 6).alias("score"))


@query
def unify_names(t):
    variants = t.entities.select("normalized_name").distinct().select(
        F.col("normalized_name").alias("variant"), T.first_word(F.col("normalized_name")).alias("canonical")
    ).filter("canonical in ('hot', 'cold')")
    return analytics.unify_names(t.entities.select("normalized_name"), variants).groupBy("canonical_name").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def query_cache(t):
    cache = t.questions.groupBy(F.col("text").alias("query_text")).agg(
        F.min("query_id").alias("llm_response"), F.lit(0).cast("long").alias("hit_count")
    ).filter("query_text like '%src1%'")
    return analytics.count_cache_hits(cache, t.questions)


@query
def cached_results(t):
    cache = t.questions.groupBy(F.col("text").alias("query_text")).agg(
        F.min("query_id").alias("llm_response"), F.collect_set(F.lit("c")).alias("result_chunks")
    ).filter("query_text like '%src1%'")
    return analytics.cached_results(t.questions, cache).select("query_id", "llm_response")


@query
def search_history(t):
    results = t.questions.filter("text like '%src1%'")
    return analytics.history_counts(analytics.search_history(results, t.questions))


@query
def extracted_items(t):
    return analytics.extracted_items(t.doc_messages, ["line_number"])


@query
def message_blocks(t):
    return analytics.block_rows(t.event_messages)


@query
def contact_profiles(t):
    return analytics.profile_rows(analytics.block_rows(t.event_messages))


@query
def usage_metrics(t):
    return analytics.usage_metrics(t.read("events"), "event_type", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Query):
        return lambda spark, folder: build(Tables(spark, folder))

    from chatloom.streaming.catalog import STREAM_QUERIES

    return {name: bind(build) for name, build in {**QUERIES, **STREAM_QUERIES}.items()}
