"""The same queries in SQL, written from their definitions and run by another
engine over the same tables.  Named pieces are shared as common table expressions."""

from __future__ import annotations

from chatloom.functions import constants as K
from chatloom.functions import text as T
from chatloom.operators import analytics, extraction
from chatloom.plans import catalog as C
from chatloom.plans.fixtures import DATES, query_values

ORACLES: dict[str, str] = {}

SPACE = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(s: str) -> str:
    return f"regexp_replace({s}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def u16(s: str) -> str:
    """UTF-16 length: characters outside the basic plane count twice."""
    return rf"(length({s}) + length(regexp_replace({s}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def tokens4(s: str) -> str:
    return f"CAST(ceil({u16(s)} / 4.0) AS BIGINT)"


def fold(s: str) -> str:
    return f"translate(lower({s}), '{T.ACCENTED}', '{T.PLAIN}')"


def terms(s: str) -> str:
    return rf"regexp_extract_all({fold(s)}, '[\p{{L}}\p{{N}}]+')"


def ascii_words(pattern: str) -> str:
    for look in (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"):
        pattern = pattern.replace(look, r"\b")
    return pattern.replace("(?iu)", "(?i)")


def message_type(content: str, sender: str) -> str:
    body = trim(content)
    any_of = lambda ps: " OR ".join(f"regexp_matches({body}, {lit(ascii_words(p))})" for p in ps)
    return (
        f"CASE WHEN {any_of(K.MEDIA_PATTERNS)} THEN 'media' WHEN {any_of(K.SYSTEM_PATTERNS)} THEN 'system' "
        f"WHEN {sender} IS NULL OR {trim(sender)} = '' THEN 'system' ELSE 'text' END"
    )


def iso(ts: str) -> str:
    return f"strftime(make_timestamp({ts} * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"


def hhmm(ts: str) -> str:
    return f"strftime(make_timestamp({ts} * 1000000), '%H:%M')"


def day(ts: str) -> str:
    return f"strftime(make_timestamp({ts} * 1000000), '%Y-%m-%d')"


def sid(*parts: str) -> str:
    return "sha256(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


VIEWS: dict[str, str] = {
    "messages": """SELECT CAST(conv_id AS VARCHAR) AS chat_id, role AS sender, text AS content,
        1704067200 + conv_id*604800 + turn*600*(1 + conv_id % 20) AS timestamp,
        CASE WHEN role = 'system' THEN 'system' ELSE 'text' END AS type, turn AS line_number
        FROM conversations""",
    "event_messages": """SELECT CAST(user_id AS VARCHAR) AS chat_id, event_type AS sender, props AS content,
        CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, 'text' AS type, event_id AS line_number FROM events""",
    "doc_messages": """SELECT source AS chat_id, lang AS sender, text AS content,
        1704067200 + doc_id*60 AS timestamp, 'text' AS type, doc_id AS line_number FROM documents""",
    "chats": """SELECT chat_id AS id, chat_id AS name, 'whatsapp' AS source,
        CAST(count(DISTINCT sender) AS INTEGER) AS participant_count, CAST(count(*) AS INTEGER) AS message_count,
        min(timestamp) AS first_message_at, max(timestamp) AS last_message_at,
        CAST(0 AS BIGINT) AS imported_at, '{}' AS metadata FROM messages GROUP BY chat_id""",
    "order_sessions": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS chat_id,
        CAST(epoch(o_orderdate) AS BIGINT) AS start_time, CAST(epoch(o_orderdate) AS BIGINT) + 86400 AS end_time,
        o_orderpriority AS summary FROM orders""",
    "entities": """SELECT CAST(l_orderkey*10 + l_linenumber AS VARCHAR) AS id,
        CAST(l_orderkey AS VARCHAR) AS session_id, p_name AS name, lower(trim(p_name)) AS normalized_name,
        lower(p_type) AS type, l_returnflag AS action FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "people": """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, count(o_orderkey) AS message_count
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
    "mentions": """SELECT CAST(o_orderkey AS VARCHAR) AS session_id, CAST(o_custkey AS VARCHAR) AS person_id,
        o_orderpriority AS context, o_orderstatus = 'F' AS processed FROM orders""",
    "tags": """SELECT CAST(o_custkey AS VARCHAR) AS person_id, lower(o_orderpriority) AS tag,
        CAST(epoch(o_orderdate) AS BIGINT) AS created_at FROM orders""",
    "tag_rows": """SELECT person_id, tag, min(created_at) AS created_at FROM tags GROUP BY person_id, tag""",
    "memories": """SELECT CAST(o_custkey AS VARCHAR) AS person_id, 'pedido ' || o_orderkey AS memory,
        CAST(o_orderkey AS VARCHAR) AS session_id, CAST(epoch(o_orderdate) AS BIGINT) AS created_at FROM orders""",
    "extracted": """SELECT CAST(o_orderkey AS VARCHAR) AS session_id,
        CASE o_orderstatus WHEN 'F' THEN upper(c_name) WHEN 'O' THEN 'Guest ' || c_mktsegment ELSE c_name END AS name,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE 'person' END AS type,
        o_orderpriority AS context, o_orderpriority = '1-URGENT' AS is_participant
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "routed": """SELECT e.session_id, e.name, e.context,
        (SELECT min(id) FROM people p WHERE lower(p.name) = lower(e.name)) AS person_id
        FROM extracted e WHERE NOT is_participant AND type = 'person'""",
    "pending": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS session_id,
        CASE WHEN o_orderstatus = 'F' THEN ' ' || c_mktsegment || o_orderpriority
             ELSE lower(c_mktsegment || o_orderpriority) END AS alias,
        o_orderstatus AS context, CAST(epoch(o_orderdate) AS BIGINT) * 1000 AS timestamp
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "decisions": """SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN 'lost-' || o_orderpriority
             ELSE CAST(min(o_orderkey) AS VARCHAR) END AS mention_id,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'create_new' WHEN 'AUTOMOBILE' THEN 'ignore'
             ELSE 'link_existing' END AS action,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN '7' END AS person_id
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority""",
    "decided": """SELECT p.*, d.action, d.chosen_alias,
        CASE WHEN d.action = 'create_new' THEN sha256('person|' || lower(d.chosen_alias)) ELSE d.person_id END AS person_id
        FROM pending p JOIN (
            SELECT lower(trim(q.alias)) AS k, q.alias AS chosen_alias, x.action, x.person_id
            FROM decisions x JOIN pending q ON q.id = x.mention_id
            WHERE x.action IN ('create_new', 'ignore') OR x.person_id IS NOT NULL) d
        ON d.k = lower(trim(p.alias))""",
    "questions": f"""SELECT CAST(doc_id AS VARCHAR) AS query_id,
        CASE lang WHEN 'en' THEN 'quantas vezes apareceu ' || source || ' ' || said
             WHEN 'fr' THEN 'o que aconteceu ' || said || '?'
             WHEN 'de' THEN 'Novidades de ' || source || ' ring ' || said
             ELSE 'onde está the ' || source END AS text
        FROM (SELECT *, [{', '.join(lit(d) for d in DATES)}][doc_id % {len(DATES)} + 1] AS said FROM documents)""",
    "queries": query_values("[{}]").replace("AS STRING", "AS VARCHAR"),
    "gap_rows": """SELECT *, sum(cut) OVER (PARTITION BY chat_id ORDER BY timestamp, line_number) AS seg FROM (
        SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY chat_id ORDER BY timestamp, line_number)
            <= 7200 THEN 0 ELSE 1 END AS cut FROM messages)""",
}

NEEDS = {
    "chats": ["messages"], "tag_rows": ["tags"], "routed": ["extracted", "people"],
    "decided": ["pending", "decisions"], "gap_rows": ["messages"],
}


def with_views(sql: str, *names: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order]
    parts += [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {sql}" if parts else sql


def oracle(name: str, sql: str, *views: str, recursive: bool = False, extra: dict[str, str] | None = None) -> None:
    ORACLES[name] = with_views(sql, *views, recursive=recursive, extra=extra)


# --- sources and parsing -----------------------------------------------------------

for _fmt in C.FORMATS:
    # Rendering and parsing back must give the messages, typed by their text.
    oracle(
        f"parse_roundtrip_{_fmt}",
        f"SELECT chat_id, sender, content, timestamp, {message_type('content', 'sender')} AS type FROM messages",
        "messages",
    )

_PER_MINUTE = f"SELECT *, timestamp // 60 * 60 AS minute, {message_type('content', 'sender')} AS kind FROM messages"
oracle(
    "export_files",
    """SELECT chat_id, sender, content, minute AS timestamp, kind AS type,
        row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, line_number) AS line_number FROM timed""",
    "messages", extra={"timed": _PER_MINUTE},
)
oracle(
    "file_lines",
    r"""SELECT chat_id, sum(len(parts)) :: BIGINT AS lines, sum(list_sum([length(p) FOR p IN parts])) :: BIGINT AS letters FROM (
        SELECT chat_id, string_split(strftime(make_timestamp(timestamp * 1000000), '%d/%m/%Y %H:%M') || ' - ' || sender || ': ' || content, chr(10)) AS parts
        FROM messages) GROUP BY chat_id""",
    "messages",
)
_TREE = {
    "file_lines": """SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, line_number, sub) AS n, line FROM (
        SELECT chat_id, timestamp, line_number, unnest(parts) AS line, unnest(range(len(parts))) AS sub FROM (
          SELECT *, string_split(strftime(make_timestamp(timestamp * 1000000), '%d/%m/%Y %H:%M') || ' - ' || sender || ': ' || content, chr(10)) AS parts FROM messages))""",
    "sizes": "SELECT chat_id, CAST(sum(strlen(line) + 1) AS BIGINT) AS size, max(n) AS lines FROM file_lines GROUP BY chat_id",
    "level0": "SELECT chat_id, (n - 1) // 3 + 1 AS n, sha256(string_agg(sha256(line), '' ORDER BY n)) AS d FROM file_lines GROUP BY chat_id, (n - 1) // 3",
    # Levels are built for all files until the longest one has a single node.
    **{f"level{i}": f"""SELECT chat_id, (n - 1) // 3 + 1 AS n, sha256(string_agg(d, '' ORDER BY n)) AS d FROM level{i - 1}
        WHERE (SELECT max(n) FROM level{i - 1}) > 1 GROUP BY chat_id, (n - 1) // 3
        UNION ALL SELECT * FROM level{i - 1} WHERE (SELECT max(n) FROM level{i - 1}) = 1""" for i in range(1, 9)},
}
oracle(
    "file_roots", "SELECT chat_id, size, sha256(size || ':' || d) AS root FROM level8 JOIN sizes USING (chat_id)", "messages", extra=_TREE,
)
oracle(
    "json_chats",
    f"""SELECT chat_id, {trim('sender')} AS sender, {trim('content')} AS content, timestamp, {message_type('content', 'sender')} AS type,
        row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, line_number) AS line_number FROM messages""",
    "messages",
)
oracle(
    "stream_import",
    """SELECT chat_id AS name, CAST(count(DISTINCT sender) AS INTEGER) AS participant_count, CAST(count(*) AS INTEGER) AS message_count,
        min(minute) AS first_message_at, max(minute) AS last_message_at, count(DISTINCT (minute, sender, content)) AS stored
        FROM timed GROUP BY chat_id""",
    "messages", extra={"timed": _PER_MINUTE},
)

_DOC_LINES = {
    "doc_lines": r"""SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_number, unnest(parts) AS line FROM (
        SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') AS parts
        FROM documents WHERE length(text) > 0)"""
}
oracle("read_lines", "SELECT CAST(doc_id AS VARCHAR) AS file, line_number, line FROM doc_lines", extra=_DOC_LINES)

_ORPHANS = {
    "orphans": """SELECT chat_id AS file, unnest(range(1, len(parts) + 1)) AS line_number, unnest(parts) AS line FROM (
        SELECT chat_id, string_split(content, chr(10)) AS parts FROM messages WHERE line_number = 0)"""
}
oracle(
    "parse_errors",
    """SELECT file, line_number, line, 'orphan_line' AS reason FROM orphans UNION ALL
       SELECT 'doc-' || doc_id, NULL, NULL, 'unknown_format' FROM documents WHERE length(text) > 0""",
    "messages", extra=_ORPHANS,
)
oracle(
    "parse_stats",
    """SELECT m.chat_id AS file, 'android_br' AS format,
          CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) + max(o.n) AS total_lines,
          count(*) AS total_messages, max(o.n) AS error_count, count(DISTINCT sender) AS participant_count,
          min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp
       FROM messages m JOIN (SELECT file, count(*) AS n FROM orphans GROUP BY file) o ON o.file = m.chat_id
       GROUP BY m.chat_id
       UNION ALL
       SELECT 'doc-' || doc_id, NULL, count(*), 0, 0, 0, NULL, NULL FROM doc_lines GROUP BY doc_id""",
    "messages", extra={**_ORPHANS, **_DOC_LINES},
)
oracle(
    "parse_participants",
    """SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY first_line, sender) AS position FROM (
        SELECT chat_id, sender, min(line_number) AS first_line, count(*) AS message_count
        FROM messages GROUP BY chat_id, sender)""",
    "messages",
)
oracle(
    "detect_formats",
    "SELECT f || ':' || conv_id AS file, f AS format FROM (SELECT DISTINCT conv_id FROM conversations), "
    f"(SELECT unnest([{', '.join(lit(f) for f in C.FORMATS)}]) AS f)",
)
oracle("message_type", f"SELECT doc_id, {message_type('text', 'lang')} AS type FROM documents")
oracle("chat_names", "SELECT doc_id, 'Conversa ' || source || '+v1.' || lang AS name FROM documents")
oracle("text_measures", f"SELECT doc_id, {u16('text')} AS length, {tokens4('text')} AS tokens FROM documents")
oracle(
    "keyword_cleaning",
    f"""SELECT doc_id, trim(regexp_replace(text, {lit(K.KEYWORD_DROP)}, '', 'g')) AS cleaned,
        sha256(regexp_replace(text, {lit(K.KEYWORD_DROP_NO_SPACE)}, '', 'g')) AS joined FROM documents""",
)

# --- stores ------------------------------------------------------------------------

oracle(
    "insert_or_ignore",
    """SELECT chat_id, sender, content, timestamp, any_value(type) AS type, min(line_number) AS line_number
       FROM messages m WHERE NOT EXISTS (SELECT 1 FROM messages s WHERE s.sender = 'assistant'
         AND (s.chat_id, s.timestamp, s.sender, s.content) = (m.chat_id, m.timestamp, m.sender, m.content))
       GROUP BY chat_id, timestamp, sender, content""",
    "messages",
)
oracle(
    "file_hash_dedup",
    """SELECT sha256(text) AS file_hash, min(format('{:012d}', doc_id)) AS file FROM documents
       WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark) GROUP BY 1""",
)
oracle("chat_rows", "SELECT * FROM chats", "chats")
oracle(
    "refresh_chats",
    """SELECT c.id, CAST(coalesce(m.p, 0) AS INTEGER) AS participant_count, CAST(coalesce(m.n, 0) AS INTEGER) AS message_count,
        m.lo AS first_message_at, m.hi AS last_message_at FROM chats c LEFT JOIN (
        SELECT chat_id, count(DISTINCT sender) AS p, count(*) AS n, min(timestamp) AS lo, max(timestamp) AS hi
        FROM messages WHERE type <> 'system' GROUP BY chat_id) m ON m.chat_id = c.id""",
    "chats",
)
oracle(
    "update_summaries",
    """SELECT s.id, s.chat_id, s.start_time, s.end_time, coalesce(u.f, s.summary) AS summary
       FROM order_sessions s LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS id, max(l_returnflag) AS f
         FROM lineitem GROUP BY 1) u ON u.id = s.id""",
    "order_sessions",
)
oracle(
    "upsert_latest",
    """SELECT CAST(user_id AS VARCHAR) AS contact_id, event_type AS block_index, arg_max(props, event_id) AS summary_text,
       max(event_id) AS version FROM events GROUP BY 1, 2""",
)
oracle(
    "upsert_profiles",
    """SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS contact_id,
       CASE WHEN arg_max(o_orderstatus, o_orderkey) = 'F' THEN 'm1' ELSE 'llm-worker' END AS model_used,
       arg_max(o_orderpriority, o_orderkey) AS profile_text, max(o_orderkey) AS updated_at FROM orders GROUP BY o_custkey""",
)
_ALIVE = {
    "dead": "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment = 'BUILDING'",
    "dead_sessions": "SELECT id FROM order_sessions WHERE chat_id IN (SELECT id FROM dead)",
}


def _left(name: str, key: str, keep: str) -> str:
    return f"SELECT '{name}' AS table_name, count(*) AS n, CAST(sum(CAST({key} AS BIGINT)) AS BIGINT) AS keys FROM {keep}"


oracle(
    "cascade_delete",
    " UNION ALL ".join([
        _left("chats", "id", "people WHERE id NOT IN (SELECT id FROM dead)"),
        _left("messages", "line_number", "event_messages WHERE chat_id NOT IN (SELECT id FROM dead)"),
        _left("sessions", "id", "order_sessions WHERE chat_id NOT IN (SELECT id FROM dead)"),
        _left("entities", "id", "entities WHERE session_id NOT IN (SELECT id FROM dead_sessions)"),
        _left("person_mentions", "session_id", "mentions WHERE session_id NOT IN (SELECT id FROM dead_sessions)"),
        _left(
            "person_key_memories", "session_id",
            "(SELECT CASE WHEN session_id NOT IN (SELECT id FROM dead_sessions) THEN session_id END AS session_id FROM memories)",
        ),
    ]),
    "people", "event_messages", "order_sessions", "entities", "mentions", "memories", extra=_ALIVE,
)
oracle("retention", f"SELECT id FROM chats WHERE last_message_at < {C.NOW} - 365 * 86400", "chats")
oracle(
    "json_columns",
    """SELECT id, '{"name":"' || name || '","message_count":' || message_count || '}' AS metadata,
       message_count AS decoded_count FROM chats""",
    "chats",
)

# --- sessions and chunks -------------------------------------------------------------

_SESSION = f"""SELECT {sid('chat_id', 'start_time', 'first_line')} AS id, chat_id, start_time, end_time, message_count, text_count
    FROM (SELECT chat_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS message_count,
      count(*) FILTER (type = 'text') AS text_count, arg_min(line_number, (timestamp, line_number)) AS first_line
      FROM {{rows}} GROUP BY chat_id, seg)"""
oracle("gap_sessions", _SESSION.format(rows="gap_rows"), "gap_rows")
ORACLES["gap_sessions_events"] = ORACLES["gap_sessions"].replace(VIEWS["messages"], VIEWS["event_messages"])


def _budget(source: str, gap: int, budget: int) -> dict[str, str]:
    """Row after row: the running tokens and the number of the session."""
    return {
        "numbered": f"""SELECT *, {tokens4('content')} AS tok,
            row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, line_number) AS rn FROM {source}""",
        "fold": f"""SELECT chat_id, rn, timestamp, tok AS total, 1 AS seg FROM numbered WHERE rn = 1
            UNION ALL
            SELECT n.chat_id, n.rn, n.timestamp,
              CASE WHEN n.timestamp - f.timestamp > {gap} OR f.total + n.tok > {budget} THEN n.tok ELSE f.total + n.tok END,
              CASE WHEN n.timestamp - f.timestamp > {gap} OR f.total + n.tok > {budget} THEN f.seg + 1 ELSE f.seg END
            FROM fold f JOIN numbered n ON n.chat_id = f.chat_id AND n.rn = f.rn + 1""",
        "cut": "SELECT n.*, f.seg FROM numbered n JOIN fold f USING (chat_id, rn)",
    }


oracle("budget_sessions", _SESSION.format(rows="cut"), "messages", recursive=True, extra=_budget("messages", 7200, C.BUDGET))
oracle("sub_sessions", _SESSION.format(rows="cut"), "messages", recursive=True, extra=_budget("messages", 7200, 400))
oracle(
    "budget_sessions_events", _SESSION.format(rows="cut"), "event_messages", recursive=True,
    extra=_budget("event_messages", 86400, C.EVENT_BUDGET),
)
_FIRST = "first_value({c}) OVER (PARTITION BY chat_id, seg ORDER BY timestamp, line_number)"
oracle(
    "labelled_messages",
    f"""SELECT {sid('chat_id', _FIRST.format(c='timestamp'), _FIRST.format(c='line_number'))} AS session_id,
        chat_id, timestamp, line_number FROM cut""",
    "messages", recursive=True, extra=_budget("messages", 7200, C.BUDGET),
)
_LINE = f"'[' || {iso('timestamp')} || '] ' || sender || ': ' || content"
oracle(
    "transcripts",
    f"""SELECT {sid('chat_id', 'min(timestamp)', 'arg_min(line_number, (timestamp, line_number))')} AS session_id, chat_id,
        count(*) AS message_count, string_agg({_LINE}, chr(10) ORDER BY timestamp, line_number) AS transcript
        FROM cut GROUP BY chat_id, seg""",
    "messages", recursive=True, extra=_budget("messages", 7200, 1500),
)
oracle(
    "trivial_sessions",
    f"""SELECT id, CASE WHEN text_count = 0 THEN 'Sessão sem mensagens de texto.'
        ELSE 'Sessão breve com ' || message_count || ' mensagens.' END AS summary
        FROM ({_SESSION.format(rows='gap_rows')}) WHERE text_count < 3""",
    "gap_rows",
)


def _chunks(source: str, gap: int, budget: int) -> dict[str, str]:
    over = f"n.timestamp - f.timestamp > {gap} OR ceil(f.total / 4.0) + ceil(n.len / 4.0) > {budget}"
    return {
        "numbered": f"""SELECT *, {u16('content')} AS len,
            row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, line_number) AS rn,
            coalesce(sum({u16('content')}) OVER (PARTITION BY chat_id ORDER BY timestamp, line_number
              ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS carry FROM {source}""",
        "fold": f"""SELECT chat_id, rn, timestamp, CAST(len AS BIGINT) AS total, rn AS chunk_start FROM numbered WHERE rn = 1
            UNION ALL
            SELECT n.chat_id, n.rn, n.timestamp,
              CAST(CASE WHEN {over} THEN n.carry + n.len ELSE f.total + n.len END AS BIGINT),
              CASE WHEN {over} THEN n.rn ELSE f.chunk_start END
            FROM fold f JOIN numbered n ON n.chat_id = f.chat_id AND n.rn = f.rn + 1""",
        "spans": """SELECT chat_id, chunk_start, greatest(1, chunk_start - CASE WHEN chunk_start > 1 THEN 5 ELSE 0 END) AS lo,
            max(rn) AS hi FROM fold GROUP BY chat_id, chunk_start""",
        "members": """SELECT s.chunk_start, n.*, row_number() OVER (PARTITION BY n.chat_id, s.chunk_start ORDER BY n.rn) AS place,
            s.hi - s.lo + 1 AS size FROM spans s JOIN numbered n ON n.chat_id = s.chat_id AND n.rn BETWEEN s.lo AND s.hi""",
    }


_SPOKEN = "coalesce(string_agg(sender || ': ' || content, chr(10) ORDER BY rn) FILTER (type <> 'system'), '')"
_SHOWN = f"string_agg(sender || ' [' || {hhmm('timestamp')} || ']: ' || content, chr(10) ORDER BY rn)"
_SIZES = """min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS message_count,
    CAST(ceil(sum(len) / 4.0) AS BIGINT) AS token_count"""
_PARTICIPANTS = """SELECT chat_id, chunk_start, string_agg(sender, ', ' ORDER BY first) AS participants FROM (
    SELECT chat_id, chunk_start, sender, min(rn) AS first FROM members GROUP BY ALL) GROUP BY ALL"""
oracle(
    "time_window_chunks",
    f"""SELECT * FROM (SELECT chat_id, chunk_start, {_SPOKEN} AS content, {_SHOWN} AS display_content, {_SIZES}
        FROM members GROUP BY chat_id, chunk_start) JOIN ({_PARTICIPANTS}) USING (chat_id, chunk_start)""",
    "messages", recursive=True, extra=_chunks("messages", 600, C.CHUNK_BUDGET),
)
oracle(
    "snippet_lines",
    rf"""SELECT chat_id, chunk_start, line_no,
        CASE WHEN ok THEN split_part({trim("regexp_extract(line, p, 1)")}, ' ', 1) ELSE '' END AS sender,
        CASE WHEN ok THEN regexp_extract(line, p, 2) ELSE '' END AS time,
        CASE WHEN ok THEN regexp_extract(line, p, 3) ELSE line END AS text, NOT ok AS continues
        FROM (SELECT *, regexp_matches(line, p) AS ok FROM (SELECT chat_id, chunk_start,
          unnest(range(0, len(string_split(d, chr(10))))) AS line_no, unnest(string_split(d, chr(10))) AS line,
          '^([^\[]+) \[([^\]]+)\]:\s(.*)$' AS p
          FROM (SELECT chat_id, chunk_start, {_SHOWN} AS d FROM members GROUP BY ALL)))""",
    "messages", recursive=True, extra=_chunks("messages", 600, C.CHUNK_BUDGET),
)
oracle(
    "parent_child_chunks",
    f"""SELECT chat_id, chunk_start, child_index, sha256({_SPOKEN}) AS content, {_SIZES} FROM (
        SELECT *, unnest(range(0, CAST(greatest(0, ceil((size - 8) / 5.0)) AS BIGINT) + 1)) AS child_index FROM members)
        WHERE place BETWEEN child_index * 5 + 1 AND child_index * 5 + 8 GROUP BY chat_id, chunk_start, child_index""",
    "event_messages", recursive=True, extra=_chunks("event_messages", 86400, C.EVENT_BUDGET * 4),
)
oracle(
    "sliding_chunks",
    f"""SELECT chat_id, window_no, {_SIZES}, sha256({_SHOWN}) AS display FROM (
        SELECT *, unnest(range(0, CAST(greatest(0, ceil((size - 8) / 5.0)) AS BIGINT) + 1)) AS window_no FROM (
          SELECT *, {u16('content')} AS len, row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, line_number) AS rn,
            count(*) OVER (PARTITION BY chat_id) AS size FROM event_messages))
        WHERE rn BETWEEN window_no * 5 + 1 AND window_no * 5 + 8 GROUP BY chat_id, window_no""",
    "event_messages",
)
oracle(
    "turn_chunks",
    f"""SELECT chat_id, CAST(turn_no AS BIGINT) AS turn_no, min(sender) AS sender, min(timestamp) AS start_time, max(timestamp) AS end_time,
        count(*) AS message_count, CAST(sum({tokens4('content')}) AS BIGINT) AS token_count FROM (
        SELECT *, sum(new) OVER (PARTITION BY chat_id ORDER BY timestamp, line_number) AS turn_no FROM (
        SELECT *, CASE WHEN lag(sender) OVER (PARTITION BY chat_id ORDER BY timestamp, line_number) = sender
          THEN 0 ELSE 1 END AS new FROM event_messages)) GROUP BY chat_id, turn_no""",
    "event_messages",
)
oracle(
    "message_chunks",
    f"SELECT chat_id, timestamp, line_number, sender || ': ' || content AS content, {tokens4('content')} AS token_count FROM messages",
    "messages",
)

# --- reads -----------------------------------------------------------------------------

oracle("all_chats", "SELECT id, message_count, last_message_at FROM chats", "chats")
oracle(
    "chats_by_id",
    "SELECT id, message_count FROM chats WHERE id IN (SELECT chat_id FROM messages WHERE sender = 'system')", "chats",
)
oracle(
    "chat_pages",
    """SELECT chat_id, pos, timestamp, line_number FROM (SELECT *, row_number() OVER (PARTITION BY chat_id
       ORDER BY timestamp, line_number) AS pos FROM event_messages) WHERE pos BETWEEN 11 AND 30""",
    "event_messages",
)
oracle(
    "counts_per_chat",
    "SELECT chat_id, count(*) AS messages, count(DISTINCT seg) AS sessions FROM gap_rows GROUP BY chat_id", "gap_rows",
)
oracle(
    "chat_participants",
    "SELECT chat_id, sender, count(*) AS message_count FROM messages WHERE type <> 'system' GROUP BY ALL", "messages",
)
oracle(
    "entities_by_chat",
    """SELECT chat_id, normalized_name, count(*) AS n FROM entities e JOIN order_sessions s ON s.id = e.session_id
       GROUP BY chat_id, normalized_name""",
    "entities", "order_sessions",
)
oracle("people_by_activity", "SELECT * FROM people", "people")
oracle(
    "person_tags",
    "SELECT person_id, tag, created_at FROM tags WHERE person_id IN (SELECT id FROM people WHERE message_count > 10)",
    "tags", "people",
)
oracle(
    "person_memories",
    """SELECT CAST(o_custkey AS VARCHAR) AS person_id, 'pedido ' || o_orderkey AS memory, CAST(epoch(o_orderdate) AS BIGINT) AS created_at
       FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT id FROM people WHERE message_count > 10)""",
    "people",
)
oracle(
    "chat_sessions",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS chat_id, CAST(epoch(o_orderdate) AS BIGINT) AS start_time,
         CAST(epoch(o_orderdate) AS BIGINT) + 86400 AS end_time, o_orderpriority AS summary
       FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)""",
)
oracle(
    "entities_by_chat",
    """SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id, CAST(l_orderkey AS VARCHAR) AS session_id,
         CAST(o_custkey AS VARCHAR) AS chat_id, lower(trim(p_name)) AS normalized_name, lower(p_type) AS type
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey""",
)
oracle(
    "session_range_join",
    f"""SELECT s.id AS session_id, m.chat_id, m.timestamp, m.line_number FROM ({_SESSION.format(rows='cut')}) s
        JOIN messages m ON m.chat_id = s.chat_id AND m.timestamp BETWEEN s.start_time AND s.end_time""",
    "messages", recursive=True, extra=_budget("messages", 7200, C.BUDGET),
)
oracle(
    "filtered_messages",
    f"""SELECT * FROM messages WHERE chat_id IN (SELECT id FROM chats WHERE participant_count = 3)
        AND sender IN (SELECT sender FROM messages WHERE type = 'system') AND timestamp BETWEEN 1704067200 AND {C.NOW}""",
    "chats",
)

# --- search ----------------------------------------------------------------------------


def _posted(source: str, keys: str, fields: list[str]) -> str:
    """Positions of every word of every field."""
    one = lambda i, f: (
        f"SELECT {keys}, CAST({i} AS INTEGER) AS field, unnest(range(0, len(w))) AS pos, unnest(w) AS term "
        f"FROM (SELECT {keys}, {terms(f)} AS w FROM {source})"
    )
    return " UNION ALL ".join(one(i, f) for i, f in enumerate(fields))


oracle(
    "search_vocabulary",
    f"""SELECT term, count(DISTINCT line_number) AS doc_count, count(*) AS occurrences
        FROM ({_posted('doc_messages', 'line_number', ['sender', 'content'])}) GROUP BY term""",
    "doc_messages",
)

def _matching(source: str, keys: str, fields: list[str], queries: str = "queries", drop: str = K.KEYWORD_DROP) -> dict[str, str]:
    """Phrases, word positions, hits per phrase and document, and BM25 scores."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    words = "[x for x in parts]"
    qualified = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    hit_keys = ", ".join(f"h.{k.strip()}" for k in keys.split(","))
    return {
        "phrases": f"""SELECT query_id, kw_no, {terms('kw')} AS w FROM (
            SELECT query_id, unnest(range(0, len(ks))) AS kw_no, unnest(ks) AS kw FROM (
              SELECT query_id, list_filter(list_transform(keywords, lambda k: trim(regexp_replace(k, {lit(drop)}, '', 'g'))),
                lambda k: k <> '') AS ks FROM {queries}))
            WHERE len({terms('kw')}) > 0""",
        "posted": _posted(source, keys, fields),
        "sized": f"SELECT {keys}, " + " + ".join(f"len({terms(f)})" for f in fields) + f" AS dl FROM {source}",
        "totals": "SELECT count(*) AS n, sum(dl) AS words FROM sized",
        # The last word is a prefix; the words before it stand right in front of it.
        "hits": f"""SELECT query_id, kw_no, {qualified}, count(*) AS tf FROM phrases f JOIN posted p
            ON starts_with(p.term, f.w[-1])
            WHERE len(f.w) = 1 OR EXISTS (SELECT 1 FROM posted b WHERE {on('b', 'p')} AND b.field = p.field
              AND b.pos = p.pos - 1 AND b.term = f.w[-2] AND len(f.w) = 2)
            GROUP BY query_id, kw_no, {qualified}""",
        "found": "SELECT query_id, kw_no, count(*) AS df FROM hits GROUP BY query_id, kw_no",
        "scores": f"""SELECT query_id, {keys}, round(sum(s), 12) AS score FROM (
            SELECT h.query_id, {hit_keys}, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5)))
              * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * n / words))) AS s
            FROM hits h JOIN found f USING (query_id, kw_no) JOIN sized z ON {on('z', 'h')}, totals)
            GROUP BY query_id, {keys}""",
    }


def _top(rows: str, order: str, k: int, group: str = "query_id") -> str:
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS INTEGER) AS rank
        FROM {rows}) WHERE rank <= {k}"""


_KEY = "chat_id, timestamp, line_number"
_IN_MESSAGES = _matching("messages", _KEY, ["sender", "content"])
_PIVOTS = _top("scores", f"score DESC, {_KEY}", 5)
oracle("search_pivots", _PIVOTS, "messages", "queries", extra=_IN_MESSAGES)


def _windows(size: int) -> dict[str, str]:
    return {
        "pivots": _PIVOTS,
        "placed": "SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, line_number) AS pos FROM messages",
        "near": f"""SELECT DISTINCT p.query_id, p.rank, m.* FROM pivots p JOIN (
              SELECT chat_id, timestamp, min(pos) AS lo, max(pos) AS hi FROM placed GROUP BY ALL) t
              ON t.chat_id = p.chat_id AND t.timestamp = p.timestamp
            JOIN placed m ON m.chat_id = p.chat_id
              AND (m.pos BETWEEN t.hi - {size} AND t.hi OR m.pos BETWEEN t.lo AND t.lo + {size})""",
    }


oracle(
    "search_factual", "SELECT query_id, rank, chat_id, timestamp, line_number FROM near",
    "messages", "queries", extra={**_IN_MESSAGES, **_windows(2)},
)
oracle(
    "search_documents", _top("scores", "score DESC, line_number", 10), "doc_messages", "queries",
    extra=_matching("doc_messages", "line_number", ["content"]),
)
# As many queries as documents: words of every document, then positions joined word by word.
_MANY = {
    "doc_words": f"SELECT doc_id, {terms('text')} AS w FROM documents WHERE len({terms('text')}) > 0",
    "asked": """SELECT CAST(doc_id AS VARCHAR) AS query_id, kw_no, kw FROM (
        SELECT doc_id, unnest([0, 1]) AS kw_no, unnest([
          substr(array_to_string(w[doc_id * 7 % len(w) + 1 : doc_id * 7 % len(w) + 1 + doc_id % 4], ' '), 1, 24), substr(w[1], 1, 6)]) AS kw
        FROM doc_words)""",
    "phrases": f"SELECT query_id, kw_no, {terms('kw')} AS w FROM asked",
    "posted": _posted("messages", _KEY, ["sender", "content"]),
    "sized": f"SELECT {_KEY}, len({terms('sender')}) + len({terms('content')}) AS dl FROM messages",
    "totals": "SELECT count(*) AS n, sum(dl) AS words FROM sized",
    "vocabulary": "SELECT DISTINCT term FROM posted",
    "lasts": "SELECT DISTINCT w[-1] AS last FROM phrases",
    "completing": """SELECT l.last, v.term FROM lasts l JOIN (
        SELECT term, unnest(range(1, length(term) + 1)) AS k FROM vocabulary) v ON substr(v.term, 1, v.k) = l.last AND v.k = length(l.last)""",
    "ended": "SELECT f.query_id, f.kw_no, f.w, p.* FROM phrases f JOIN completing c ON c.last = f.w[-1] JOIN posted p ON p.term = c.term",
    **{f"step{i}": f"""SELECT e.* FROM {'ended' if i == 1 else f'step{i - 1}'} e LEFT JOIN posted b
        ON len(e.w) > {i} AND b.term = e.w[-{i + 1}] AND b.field = e.field AND b.pos = e.pos - {i}
        AND b.chat_id = e.chat_id AND b.timestamp = e.timestamp AND b.line_number = e.line_number
        WHERE len(e.w) <= {i} OR b.term IS NOT NULL""" for i in (1, 2, 3)},
    "hits": f"SELECT query_id, kw_no, {_KEY}, count(*) AS tf FROM step3 GROUP BY query_id, kw_no, {_KEY}",
    "found": "SELECT query_id, kw_no, count(*) AS df FROM hits GROUP BY query_id, kw_no",
    "scores": f"""SELECT query_id, {_KEY}, round(sum(s), 12) AS score FROM (
        SELECT h.query_id, h.chat_id, h.timestamp, h.line_number, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5)))
          * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * n / words))) AS s
        FROM hits h JOIN found f USING (query_id, kw_no) JOIN sized z USING ({_KEY}), totals) GROUP BY query_id, {_KEY}""",
}
oracle("search_many", _top("scores", f"score DESC, {_KEY}", 3), "messages", extra=_MANY)
_DATED = """(coalesce(q.date_from, 0) = 0 OR s.start_time >= q.date_from)
    AND (coalesce(q.date_to, 0) = 0 OR s.end_time <= q.date_to)"""
_TOLD = {"told": "SELECT * FROM queries WHERE NOT list_contains(keywords, '#RECENT#')"}
_NARRATIVE = {
    **_TOLD, **_matching("order_sessions", "id", ["summary"], "told", K.KEYWORD_DROP_NO_SPACE),
    "narrative": _top(
        f"(SELECT x.query_id, x.id, x.score, s.chat_id, s.start_time, s.end_time, s.summary FROM scores x "
        f"JOIN order_sessions s ON s.id = x.id JOIN queries q ON q.query_id = x.query_id WHERE {_DATED})",
        "score DESC, id", 5,
    ),
}
oracle("search_narrative", "SELECT * FROM narrative", "order_sessions", "queries", extra=_NARRATIVE)
_RECENT = {
    "recent": f"""SELECT query_id, id, chat_id, start_time, end_time, summary,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC) AS INTEGER) AS rank FROM (
        SELECT q.query_id, s.*, row_number() OVER (PARTITION BY q.query_id ORDER BY s.start_time DESC, s.id DESC) AS n
        FROM queries q, order_sessions s WHERE list_contains(q.keywords, '#RECENT#') AND {_DATED}) WHERE n <= 5"""
}
oracle("search_recent", "SELECT * FROM recent", "order_sessions", "queries", extra=_RECENT)


def _counted(queries: str = "queries", k: int = 20) -> dict[str, str]:
    text = "name, normalized_name, type, action"
    m = _matching("texts", text, ["name", "type", "action"], queries)
    return {
        "texts": f"SELECT DISTINCT {text} FROM entities",
        **{n: m[n] for n in ("phrases", "posted", "hits")},
        "counted": _top(
            f"""(SELECT h.query_id, e.normalized_name AS name, e.type, count(*) AS count
                FROM (SELECT DISTINCT query_id, {text} FROM hits) h
                JOIN entities e ON (e.name, e.type, e.action) = (h.name, h.type, h.action)
                JOIN order_sessions s ON s.id = e.session_id JOIN queries q ON q.query_id = h.query_id
                WHERE {_DATED} GROUP BY ALL)""",
            "count DESC, name, type", k,
        ),
    }


oracle("search_aggregation", "SELECT * FROM counted", "entities", "order_sessions", "queries", extra=_counted())
_HOPPED = """SELECT q.query_id, array_to_string(list_distinct_in_order, '|') AS keywords FROM (
    SELECT query_id, list(w ORDER BY first) AS list_distinct_in_order FROM (
      SELECT query_id, w, min(place) AS first FROM (
        SELECT query_id, unnest(keywords) AS w, unnest(range(0, len(keywords))) AS place FROM queries
        UNION ALL SELECT query_id, name, 1000 + rank FROM counted) GROUP BY query_id, w) GROUP BY query_id) x
    RIGHT JOIN queries q ON q.query_id = x.query_id"""
oracle(
    "entity_hop",
    "SELECT query_id, coalesce(keywords, '') AS keywords FROM (" + _HOPPED + ")",
    "entities", "order_sessions", "queries", extra=_counted(k=8),
)


def _prefixed(ctes: dict[str, str], prefix: str, rename: list[str]) -> dict[str, str]:
    """The same pieces under other names, so that several searches fit one statement."""
    import re

    out = {}
    for name, sql in ctes.items():
        for r in rename:
            sql = re.sub(rf"\b(FROM|JOIN|,) {r}\b", rf"\1 {prefix}{r}", sql)
        out[f"{prefix}{name}" if name in rename else name] = sql
    return out


_PIECES = ["phrases", "posted", "sized", "totals", "hits", "found", "scores"]


def _routed_parts(hop: bool) -> dict[str, str]:
    filled = """SELECT query_id, text, intent, CASE WHEN len(keywords) = 0 THEN [text] ELSE keywords END AS keywords,
        date_from, date_to, chat_id FROM queries"""
    parts = {"filled": filled}
    if hop:
        names = _prefixed(_counted("filled", 8), "hop_", ["texts", *_PIECES, "counted"])
        parts.update(names)
        parts["asked"] = """SELECT f.* REPLACE (list_concat(f.keywords, list_filter(coalesce(n.names, []),
            lambda w: NOT list_contains(f.keywords, w))) AS keywords)
            FROM filled f LEFT JOIN (SELECT query_id, list(name ORDER BY first) AS names FROM (
              SELECT query_id, name, min(rank) AS first FROM hop_counted GROUP BY query_id, name) GROUP BY query_id) n
            ON n.query_id = f.query_id"""
    else:
        parts["asked"] = "SELECT * FROM filled"
    parts["q_agg"] = "SELECT * FROM asked WHERE intent = 'aggregation'"
    parts["q_told"] = "SELECT * FROM asked WHERE intent = 'narrative' AND NOT list_contains(keywords, '#RECENT#')"
    parts["q_fact"] = "SELECT * FROM asked WHERE intent NOT IN ('aggregation', 'narrative')"
    parts.update(_prefixed(_counted("q_agg", 20), "agg_", ["texts", *_PIECES, "counted"]))
    narrative = {
        **_matching("order_sessions", "id", ["summary"], "q_told", K.KEYWORD_DROP_NO_SPACE),
        "narrative": _NARRATIVE["narrative"],
    }
    parts.update(_prefixed(narrative, "nar_", [*_PIECES, "narrative"]))
    parts.update(_RECENT)
    parts.update({**_matching("messages", _KEY, ["sender", "content"], "q_fact"), **_windows(15)})
    parts["results"] = f"""
        SELECT query_id, 1 AS rank, 'aggregation' AS kind, '' AS chat_id, 'Global Aggregations' AS chat_name, 1.0::DOUBLE AS score,
          CAST(NULL AS BIGINT) AS start_time, 'System' AS sender, 'Aggregation Results:' || chr(10) ||
          string_agg('- Entity: ' || name || ' (' || type || ') | Count: ' || count || chr(10), '' ORDER BY rank) AS content
        FROM agg_counted GROUP BY query_id
        UNION ALL
        SELECT query_id, rank, 'narrative', s.chat_id, coalesce(c.name, 'Unknown Chat'), 0.9::DOUBLE, start_time, 'System',
          'SESSION SUMMARY' || chr(10) || summary
        FROM (SELECT query_id, rank, chat_id, start_time, summary FROM nar_narrative
              UNION ALL SELECT query_id, rank, chat_id, start_time, summary FROM recent) s LEFT JOIN chats c ON c.id = s.chat_id
        UNION ALL
        SELECT query_id, rank, 'factual', n.chat_id, coalesce(any_value(c.name), 'Unknown Chat'), 1.0::DOUBLE, min(timestamp),
          arg_min(sender, pos), {trim(f"string_agg('[' || {hhmm('timestamp')} || '] ' || sender || ': ' || content, chr(10) ORDER BY pos)")}
        FROM near n LEFT JOIN chats c ON c.id = n.chat_id GROUP BY query_id, rank, n.chat_id"""
    return parts


_ROUTED_VIEWS = ("messages", "chats", "entities", "order_sessions", "queries")
oracle("routed_search", "SELECT * FROM results", *_ROUTED_VIEWS, extra=_routed_parts(True))
oracle(
    "neighbours",
    f"""SELECT request_id, kind, chat_id, timestamp, line_number FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id, kind ORDER BY
            CASE WHEN kind = 'before' THEN -timestamp ELSE timestamp END,
            CASE WHEN kind = 'before' THEN -line_number ELSE line_number END) AS n FROM (
          SELECT r.*, CASE WHEN p.ts IS NULL THEN 'opening' WHEN r.timestamp < p.ts THEN 'before'
              WHEN r.timestamp > p.ts THEN 'after' WHEN r.line_number = p.line THEN 'pivot' END AS kind
          FROM spoken r LEFT JOIN (SELECT request_id, min(timestamp) AS ts, arg_min(line_number, (timestamp, line_number)) AS line
            FROM spoken WHERE contains(lower(content), lower(snippet)) GROUP BY request_id) p USING (request_id))
        WHERE kind IS NOT NULL) WHERE n <= CASE WHEN kind = 'opening' THEN 2 ELSE 1 END""",
    "gap_rows",
    extra={
        "requests": f"""SELECT 'r-' || id AS request_id, chat_id, start_time, end_time,
            CASE WHEN message_count > 2 THEN 'THE ' ELSE 'eau' END AS snippet FROM ({_SESSION.format(rows='gap_rows')})""",
        "spoken": """SELECT r.request_id, r.snippet, m.* FROM requests r JOIN messages m
            ON m.chat_id = r.chat_id AND m.timestamp BETWEEN r.start_time AND r.end_time""",
    },
)
oracle(
    "alias_match",
    _top("(SELECT x.*, p.name FROM scores x JOIN people p ON p.id = x.person_id)", "score DESC, person_id, alias", 5),
    "people",
    extra={
        "aliases": "SELECT id AS person_id, replace(name, '#', ' ') AS alias FROM people",
        "asked": """SELECT c_mktsegment AS query_id, [replace(left(max(c_name), length(max(c_name)) - 2), '#', ' ')] AS keywords
            FROM customer GROUP BY c_mktsegment""",
        **_matching("aliases", "person_id, alias", ["alias"], "asked"),
    },
)
oracle(
    "highlight",
    r"SELECT chat_id, line_number, regexp_replace(content, '(?i)(heit|the|étre)', '<mark>\1</mark>', 'g') AS marked FROM messages",
    "messages",
)
oracle(
    "suggestions",
    _top(
        f"""(SELECT prefix, term, count(DISTINCT line_number) AS doc_count, count(*) AS occurrences FROM posted
            JOIN (SELECT DISTINCT {fold('left(text, 2)')} AS prefix FROM documents) ON starts_with(term, prefix)
            WHERE prefix <> '' GROUP BY prefix, term)""",
        "occurrences DESC, term", 5, "prefix",
    ),
    "doc_messages", extra={"posted": _posted("doc_messages", "line_number", ["content"])},
)

# --- people ----------------------------------------------------------------------------

oracle(
    "sender_counts",
    "SELECT sender, count(*) AS message_count, max(timestamp) AS last_seen FROM event_messages GROUP BY sender", "event_messages",
)
_PALETTE = "[" + ", ".join(lit(c) for c in K.PALETTE) + "]"


def _color(name: str) -> str:
    return f"({_PALETTE})[CAST(('0x' || left(sha256({name}), 6))::BIGINT % 10 + 1 AS BIGINT)]"


oracle("person_colors", f"SELECT id, {_color('name')} AS color FROM people", "people")
oracle(
    "people_upsert",
    f"""SELECT coalesce(k.id, sha256('person|' || lower(n.sender))) AS id, coalesce(k.name, n.sender) AS name,
        {_color('coalesce(k.name, n.sender)')} AS color, coalesce(k.n, 0) + coalesce(n.n, 0) AS message_count,
        n.seen AS last_seen, k.id IS NULL AS created
        FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_name) AS name, 1 AS n FROM customer) k
        FULL JOIN (SELECT lower(s) AS k, min(s) AS sender, count(*) AS n, max(CAST(epoch(o_orderdate) AS BIGINT)) AS seen FROM (
          SELECT CASE WHEN o_orderstatus = 'F' THEN 'New ' || c_name ELSE c_name END AS s, o_orderdate
          FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY lower(s)) n ON n.k = lower(k.name)""",
)
oracle(
    "entity_rows",
    f"""SELECT {sid('session_id', '0')} AS id, session_id, name, lower(trim(name)) AS normalized_name, type,
        context AS action, context, is_participant FROM extracted""",
    "extracted",
)
oracle("mention_routing", "SELECT * FROM routed", "routed")
oracle(
    "link_mentions",
    """SELECT session_id, person_id, context, false AS processed FROM routed r WHERE person_id IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.processed AND m.session_id = r.session_id AND m.person_id = r.person_id)""",
    "routed", "mentions",
)
oracle(
    "pending_inbox",
    f"""SELECT {sid('session_id', '0')} AS id, session_id, name AS alias, context, CAST(5 AS BIGINT) AS timestamp
        FROM routed WHERE person_id IS NULL""",
    "routed",
)
oracle(
    "mention_clones",
    """SELECT id, alias FROM pending WHERE lower(trim(alias)) IN (
       SELECT lower(trim(alias)) FROM pending WHERE id IN (SELECT mention_id FROM decisions))""",
    "pending", "decisions",
)
oracle(
    "resolve_people",
    "SELECT DISTINCT person_id AS id, chosen_alias AS name FROM decided WHERE action = 'create_new'", "decided",
)
oracle(
    "resolve_aliases",
    "SELECT DISTINCT person_id, chosen_alias AS alias FROM decided WHERE action <> 'ignore'", "decided",
)
oracle(
    "resolve_mentions",
    """SELECT session_id, person_id, arg_min(context, id) AS context FROM decided WHERE action <> 'ignore'
       GROUP BY session_id, person_id""",
    "decided",
)
oracle("resolve_pending", "SELECT * FROM pending WHERE id NOT IN (SELECT id FROM decided)", "decided")
oracle(
    "resolve_errors",
    """SELECT mention_id, CASE WHEN mention_id NOT IN (SELECT id FROM pending) THEN 'mention_not_found'
         ELSE 'person_id_required' END AS reason FROM decisions
       WHERE mention_id NOT IN (SELECT id FROM pending) OR (action = 'link_existing' AND person_id IS NULL)""",
    "pending", "decisions",
)
oracle(
    "tags_insert",
    f"""SELECT {sid('person_id', 'tag')} AS id, person_id, tag, 'map_reduce' AS source, created_at FROM tag_rows
        WHERE tag <> '5-low'""",
    "tag_rows",
)
oracle(
    "memories_insert",
    f"SELECT {sid('person_id', 'session_id', 'memory')} AS id, person_id, memory, session_id, created_at FROM memories",
    "memories",
)
_OPEN = """SELECT m.session_id, m.person_id, m.context, s.summary FROM mentions m
    LEFT JOIN (SELECT * FROM order_sessions WHERE summary <> '2-HIGH') s ON s.id = m.session_id WHERE NOT processed"""
oracle("unprocessed_mentions", _OPEN, "mentions", "order_sessions")


def _blocks(rows: str, size: int) -> str:
    line = """coalesce('- Sessão: "' || summary || '"' || chr(10), '') || '  Contexto da menção: "' || context || '"'"""
    return f"""SELECT person_id, (pos - 1) // {size} AS part, any_value(first_one) AS first_session, count(*) AS mentions,
        string_agg({line}, chr(10) ORDER BY pos) AS context FROM (
        SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY session_id) AS pos,
          min(session_id) OVER (PARTITION BY person_id) AS first_one FROM ({rows})) GROUP BY person_id, part"""


oracle("context_blocks", _blocks(_OPEN, 4), "mentions", "order_sessions")
oracle(
    "mark_processed",
    "SELECT session_id, person_id, context, processed OR context = '5-LOW' AS processed FROM mentions", "mentions",
)

# --- extraction --------------------------------------------------------------------------

oracle(
    "json_recovery",
    """SELECT CAST(doc_id AS VARCHAR) AS session_id, CASE WHEN lang IN ('en', 'fr', 'de') THEN 'ok' ELSE 'failed' END AS status,
       CASE WHEN lang IN ('en', 'fr', 'de') THEN source ELSE 'Sessão extraída via fallback de erro' END AS summary,
       CAST(0 AS BIGINT) AS entities FROM documents""",
)
_MONTHS = "janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
_DAYS = "segunda|terca|quarta|quinta|sexta|sabado|domingo"
_SOME = "([0-9]{1,3}|uma|duas|um|dois|tres|quatro|cinco|seis|sete|oito|nove|dez) (dias?|semanas?|mes|meses|anos?)"
_SAID = (
    r"\b((desde|ate|antes de|antes do|antes da|depois de|depois do|depois da|apos) ((o|a|os|as) )?(dia )?)?("
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}(/[0-9]{4})?|[0-9]{1,2} de (" + _MONTHS + r")( de [0-9]{4})?|(" + _MONTHS
    + r")( de [0-9]{4})?|anteontem|ontem|hoje|(semana|mes|ano) passad[oa]|ultim[oa] (semana|mes|ano)|(nest|ness|est|ess)[ea] (semana|mes|ano)"
    r"|fim de semana|ultim[oa]s " + _SOME + "|ha " + _SOME + "|" + _SOME + " atras|(" + _DAYS + r")(-feira| feira)?|em (19|20)[0-9]{2})\b"
)
_FOLDED = fold("text")
_CORE = r"regexp_replace(m, '^(desde|ate|antes de|antes do|antes da|depois de|depois do|depois da|apos) ((o|a|os|as) )?(dia )?', '')"
# Every mention as a row, then its first and last day, then the bounds of a question.
_DATE_STEPS = {
    "said": f"""SELECT query_id, CAST(make_timestamp(moment * 1000000) AS DATE) AS today, unnest(regexp_extract_all({_FOLDED}, {lit(_SAID)})) AS m FROM asked_at""",
    "cored": f"SELECT *, {_CORE} AS c FROM said",
    "numbered": f"""SELECT *, regexp_extract(c, '{_SOME}', 1) AS n_text, regexp_extract(c, '{_SOME}', 2) AS unit,
        list_position(['um', 'dois', 'tres', 'quatro', 'cinco', 'seis', 'sete', 'oito', 'nove', 'dez'],
          replace(replace(regexp_extract(c, '{_SOME}', 1), 'uma', 'um'), 'duas', 'dois')) AS n_word,
        list_position(string_split('{_MONTHS}', '|'), regexp_extract(c, '({_MONTHS})', 1)) AS month,
        list_position(string_split('{_DAYS}', '|'), regexp_extract(c, '^({_DAYS})', 1)) AS weekday,
        regexp_extract(c, ' de ([0-9]{{4}})$', 1) AS named_year, regexp_extract(c, '(semana|mes|ano)', 1) AS period FROM cored""",
    "counted_dates": """SELECT *, CASE WHEN unit IS NULL OR unit = '' THEN NULL ELSE CASE
          WHEN starts_with(unit, 'dia') THEN today - CAST(n AS INTEGER)
          WHEN starts_with(unit, 'semana') THEN today - CAST(7 * n AS INTEGER)
          WHEN starts_with(unit, 'mes') THEN CAST(today - to_months(CAST(n AS INTEGER)) AS DATE)
          ELSE CAST(today - to_months(CAST(12 * n AS INTEGER)) AS DATE) END END AS back,
        CAST(date_trunc(CASE period WHEN 'semana' THEN 'week' WHEN 'mes' THEN 'month' ELSE 'year' END, today) AS DATE) AS opening
        FROM (SELECT *, coalesce(try_cast(n_text AS INTEGER), n_word, 0) AS n FROM numbered)""",
    "placed_dates": """SELECT query_id, m, CASE
        WHEN regexp_full_match(c, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN {'a': try_cast(c AS DATE), 'b': try_cast(c AS DATE)}
        WHEN regexp_full_match(c, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN {'a': try_strptime(c, '%d/%m/%Y')::DATE, 'b': try_strptime(c, '%d/%m/%Y')::DATE}
        WHEN regexp_full_match(c, '[0-9]{1,2}/[0-9]{1,2}') THEN (CASE WHEN try_strptime(c || '/' || year(today), '%d/%m/%Y')::DATE > today
          THEN {'a': try_strptime(c || '/' || (year(today) - 1), '%d/%m/%Y')::DATE, 'b': try_strptime(c || '/' || (year(today) - 1), '%d/%m/%Y')::DATE}
          ELSE {'a': try_strptime(c || '/' || year(today), '%d/%m/%Y')::DATE, 'b': try_strptime(c || '/' || year(today), '%d/%m/%Y')::DATE} END)
        WHEN regexp_matches(c, '^[0-9]{1,2} de ') THEN (SELECT {'a': d, 'b': d} FROM (SELECT CASE WHEN named_year <> '' THEN
            try_strptime(split_part(c, ' ', 1) || '/' || month || '/' || named_year, '%d/%m/%Y')::DATE
          WHEN try_strptime(split_part(c, ' ', 1) || '/' || month || '/' || year(today), '%d/%m/%Y')::DATE > today
          THEN try_strptime(split_part(c, ' ', 1) || '/' || month || '/' || (year(today) - 1), '%d/%m/%Y')::DATE
          ELSE try_strptime(split_part(c, ' ', 1) || '/' || month || '/' || year(today), '%d/%m/%Y')::DATE END AS d))
        WHEN month > 0 THEN (SELECT {'a': d, 'b': last_day(d)} FROM (SELECT CASE WHEN named_year <> '' THEN make_date(CAST(named_year AS BIGINT), month, 1)
          WHEN month > month(today) THEN make_date(year(today) - 1, month, 1) ELSE make_date(year(today), month, 1) END AS d))
        WHEN c = 'anteontem' THEN {'a': today - 2, 'b': today - 2} WHEN c = 'ontem' THEN {'a': today - 1, 'b': today - 1}
        WHEN c = 'hoje' THEN {'a': today, 'b': today}
        WHEN c = 'fim de semana' THEN {'a': today - CAST(isodow(today) + 1 AS INTEGER), 'b': today - CAST(isodow(today) AS INTEGER)}
        WHEN regexp_matches(c, '^ultim[oa]s ') THEN {'a': back, 'b': today}
        WHEN back IS NOT NULL THEN {'a': back, 'b': back}
        WHEN regexp_matches(c, 'passad|^ultim') THEN {'a': CAST(opening - CASE period WHEN 'semana' THEN INTERVAL 7 DAY WHEN 'mes' THEN INTERVAL 1 MONTH
          ELSE INTERVAL 1 YEAR END AS DATE), 'b': opening - 1}
        WHEN period <> '' THEN {'a': opening, 'b': today}
        WHEN weekday > 0 THEN {'a': today - CAST((isodow(today) - weekday - 1 + 7) % 7 + 1 AS INTEGER), 'b': today - CAST((isodow(today) - weekday - 1 + 7) % 7 + 1 AS INTEGER)}
        WHEN regexp_matches(c, '^em [0-9]{4}$') THEN {'a': make_date(CAST(right(c, 4) AS BIGINT), 1, 1), 'b': make_date(CAST(right(c, 4) AS BIGINT), 12, 31)}
        END AS s FROM counted_dates""",
    "bounded_dates": """SELECT query_id,
        min(CASE WHEN regexp_matches(m, '^(ate|antes) ') THEN NULL WHEN regexp_matches(m, '^(depois|apos) ') THEN s.b + 1 ELSE s.a END) AS a,
        max(CASE WHEN regexp_matches(m, '^(desde|depois|apos) ') THEN NULL WHEN starts_with(m, 'antes ') THEN s.a - 1 ELSE s.b END) AS b
        FROM placed_dates WHERE s.a IS NOT NULL GROUP BY query_id""",
    "question_ranges": """SELECT q.query_id, coalesce(CAST(epoch(a) AS BIGINT), 0) AS date_from, coalesce(CAST(epoch(b) AS BIGINT) + 86399, 0) AS date_to
        FROM asked_at q LEFT JOIN bounded_dates USING (query_id)""",
}
oracle(
    "question_dates", "SELECT * FROM question_ranges", "questions",
    extra={"asked_at": "SELECT query_id, text, 883656000 - CAST(query_id AS BIGINT) * 40009 AS moment FROM questions", **_DATE_STEPS},
)


def _classified(rows: str) -> str:
    """Intent and keywords by the cues of the questions, written out once more."""
    return f"""SELECT query_id, text, intent, CASE WHEN intent = 'narrative' AND len(ks) = 0
        AND (regexp_matches({_FOLDED}, {lit(_SAID)}) OR regexp_matches({_FOLDED}, 'recente|ultimamente')) THEN ['#RECENT#'] ELSE ks END AS ks FROM (
      SELECT query_id, text, CASE WHEN regexp_matches({_FOLDED}, 'quantas vezes|quantos|ranking') THEN 'aggregation'
          WHEN regexp_matches({_FOLDED}, 'aconteceu|novidades|resumo') THEN 'narrative' ELSE 'factual' END AS intent,
        list_filter(regexp_extract_all(regexp_replace({_FOLDED}, {lit(_SAID)}, ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains(
          ['o', 'a', 'que', 'de', 'em', 'no', 'na', 'nos', 'ate', 'entre', 'e', 'quantas', 'vezes', 'apareceu', 'aconteceu', 'novidades', 'onde', 'esta', 'recentemente'], w)) AS ks
      FROM {rows})"""


_SYNONYMS = "SELECT lower(source) AS keyword, list(DISTINCT lang ORDER BY lang) AS more FROM documents WHERE source IS NOT NULL GROUP BY lower(source)"
_EXPANDED = """SELECT c.query_id, list(w ORDER BY place) AS keywords FROM classified c LEFT JOIN (
    SELECT query_id, w, min(place) AS place FROM (
      SELECT query_id, unnest(ks) AS w, unnest(range(0, len(ks))) AS place FROM classified
      UNION ALL SELECT k.query_id, unnest(s.more), 100 + k.place * 100 + unnest(range(0, len(s.more))) FROM (
        SELECT query_id, unnest(ks) AS w, unnest(range(0, len(ks))) AS place FROM classified) k JOIN synonyms s ON s.keyword = k.w)
    GROUP BY query_id, w) x ON x.query_id = c.query_id GROUP BY c.query_id"""
oracle(
    "classify_queries", "SELECT query_id, text, intent, array_to_string(ks, '|') AS keywords FROM classified",
    "questions", extra={"classified": _classified("questions")},
)
oracle(
    "expand_keywords", "SELECT query_id, coalesce(array_to_string(list_filter(keywords, lambda w: w IS NOT NULL), '|'), '') AS keywords FROM expanded",
    "questions", extra={"classified": _classified("questions"), "synonyms": _SYNONYMS, "expanded": _EXPANDED},
)


def _gap_transcripts() -> str:
    return f"""SELECT {sid('chat_id', 'min(timestamp)', 'arg_min(line_number, (timestamp, line_number))')} AS session_id, chat_id,
        min(timestamp) AS start_time, count(*) AS message_count, count(*) FILTER (type = 'text') AS text_count,
        string_agg({_LINE}, chr(10) ORDER BY timestamp, line_number) AS transcript FROM gap_rows GROUP BY chat_id, seg"""


_TASKS = {
    "session": len(extraction.SESSION_TASK), "batch": len(extraction.BATCH_TASK),
    "knowledge": len(extraction.KNOWLEDGE_TASK),
}
oracle(
    "extract_sessions",
    f"""SELECT session_id, CASE WHEN text_count = 0 THEN 'Sessão sem mensagens de texto.'
          WHEN text_count < 3 THEN 'Sessão breve com ' || message_count || ' mensagens.'
          ELSE 'len ' || (length(transcript) + {_TASKS['session']}) END AS summary,
        CASE WHEN text_count < 3 THEN 'trivial' ELSE 'ok' END AS status,
        CAST(CASE WHEN text_count < 3 THEN 0 ELSE 1 END AS INTEGER) AS attempts FROM ({_gap_transcripts()})""",
    "gap_rows",
)
# By the transcript's hash: raises once, no JSON three times or always, hangs once or always.
_MOODY = f"""SELECT *, md5(transcript) AS mark, CASE WHEN text_count < 3 THEN 'trivial' WHEN md5(transcript) LIKE '0%' THEN 'raises'
    WHEN md5(transcript) LIKE '1%' THEN 'late' WHEN md5(transcript) LIKE '20%' THEN 'hangs' WHEN md5(transcript) LIKE '3%' THEN 'never'
    WHEN md5(transcript) LIKE '40%' THEN 'stuck' ELSE 'good' END AS mood FROM ({_gap_transcripts()})"""
oracle(
    "extraction_queue",
    """SELECT session_id, CASE WHEN text_count = 0 THEN 'Sessão sem mensagens de texto.'
          WHEN mood = 'trivial' THEN 'Sessão breve com ' || message_count || ' mensagens.'
          WHEN mood = 'never' THEN 'Sessão extraída via fallback de erro' WHEN mood = 'stuck' THEN 'Sessão extraída via fallback de timeout'
          ELSE 'len ' || length(transcript) END AS summary,
        CAST(CASE WHEN mood IN ('trivial', 'never', 'stuck') THEN 0 WHEN mark[4] = '7' THEN 2 ELSE 1 END AS BIGINT) AS entities,
        CAST(CASE mood WHEN 'trivial' THEN 0 WHEN 'good' THEN 1 WHEN 'raises' THEN 2 WHEN 'hangs' THEN 2 ELSE 4 END AS INTEGER) AS attempts,
        CASE mood WHEN 'trivial' THEN 'trivial' WHEN 'never' THEN 'failed' WHEN 'stuck' THEN 'timeout' ELSE 'ok' END AS status,
        CAST(CASE mood WHEN 'trivial' THEN 0 WHEN 'good' THEN 1 WHEN 'raises' THEN 1 WHEN 'stuck' THEN 4 ELSE 2 END AS INTEGER) AS pass_no
      FROM moody""",
    "gap_rows", extra={"moody": _MOODY},
)
_CHAIN = {
    # Files do not say what type a message had; it follows from its text again.
    "typed_gap_rows": f"SELECT * REPLACE ({message_type('content', 'sender')} AS type) FROM gap_rows",
    "moody": _MOODY.replace("gap_rows", "typed_gap_rows"),
    "told": """SELECT *, lower(upper('Pessoa ' || substr(mark, 2, 2))) AS who, CASE WHEN mood IN ('trivial', 'never', 'stuck') THEN 0 WHEN mark[4] = '7' THEN 2 ELSE 1 END AS n,
        mark[1] = '5' AS own FROM moody""",
    "known": "SELECT DISTINCT 'pessoa ' || lower(printf('%02X', s_suppkey % 200)) AS name FROM supplier",
}
oracle(
    "import_chain",
    """SELECT c.id AS chat_id, participant_count, message_count, sessions, told, entities, mentions, pending FROM chats c JOIN (
        SELECT chat_id, count(*) AS sessions, count(*) FILTER (mood NOT IN ('trivial', 'never', 'stuck')) AS told, CAST(sum(n) AS BIGINT) AS entities,
          count(*) FILTER (n > 0 AND NOT own AND who IN (SELECT name FROM known)) AS mentions,
          CAST(coalesce(sum(n) FILTER (NOT own AND who NOT IN (SELECT name FROM known)), 0) AS BIGINT) AS pending
        FROM told GROUP BY chat_id) x ON x.chat_id = c.id""",
    "messages", "chats", "gap_rows", extra=_CHAIN,
)
oracle(
    "mean_extraction",
    """SELECT CASE mood WHEN 'trivial' THEN 'trivial' WHEN 'never' THEN 'failed' WHEN 'stuck' THEN 'timeout' ELSE 'ok' END AS status, count(*) AS sessions,
        CAST(sum(CASE mood WHEN 'trivial' THEN 0 WHEN 'good' THEN 1 WHEN 'raises' THEN 2 WHEN 'hangs' THEN 2 ELSE 4 END) AS BIGINT) AS attempts,
        CASE WHEN any_value(mood) <> 'trivial' THEN true END AS took_time FROM moody GROUP BY 1""",
    "gap_rows", extra={"moody": _MOODY},
)
oracle(
    "text_embeddings",
    "SELECT doc_id, " + ", ".join(f"CASE WHEN size > 0 THEN round({c} / size, 6) ELSE 0.0::DOUBLE END AS {c}" for c in "aeiou") + """ FROM (
        SELECT *, sqrt(a * a + e * e + i * i + o * o + u * u) AS size FROM (SELECT doc_id, """
    + ", ".join(f"coalesce(CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE), 0) AS {c}" for c in "aeiou") + " FROM documents))",
)
oracle("facts_by_evidence", "SELECT p_brand AS contact_id, CAST(p_size AS BIGINT) AS evidence, p_name AS text FROM part")
oracle(
    "unknown_formats",
    "SELECT CAST(doc_id AS VARCHAR) AS file, lang AS format FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')",
)
oracle(
    "session_updates",
    """SELECT coalesce(s.id, e.id) AS id, 'new ' || s.id AS summary, e.entities, e.name FROM (SELECT id FROM order_sessions WHERE CAST(id AS BIGINT) % 2 = 0) s
        FULL JOIN (SELECT session_id AS id, 1::BIGINT AS entities, lower(name) AS name FROM extracted
          WHERE CAST(session_id AS BIGINT) % 2 = 0 OR CAST(session_id AS BIGINT) % 3 = 0) e ON e.id = s.id""",
    "order_sessions", "extracted",
)
oracle(
    "batch_extract",
    f"""SELECT session_id, CASE WHEN n = 1 THEN 'len ' || CAST({_TASKS['batch']} +
          sum(length(chr(10) || '--- SESSION ' || (n - 1) || ' ---' || chr(10) || transcript || chr(10))) OVER (PARTITION BY chat_id, b)
          AS BIGINT) ELSE 'Sessão extraída via fallback de tamanho' END AS summary, 'ok' AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, b ORDER BY pos) AS n FROM (
          SELECT *, (pos - 1) // 8 AS b FROM (
            SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY start_time, session_id) AS pos FROM ({_gap_transcripts()}))))""",
    "gap_rows",
)
oracle(
    "extraction_timing",
    f"SELECT count(*) AS sessions, count(*) FILTER (text_count >= 3) AS model_sessions FROM ({_gap_transcripts()})", "gap_rows",
)
_ALL_OPEN = _OPEN.replace("(SELECT * FROM order_sessions WHERE summary <> '2-HIGH')", "order_sessions")
_KNOWN = f"SELECT *, length(context) + {_TASKS['knowledge']} AS size FROM ({_blocks(_ALL_OPEN, 200)})"
oracle(
    "person_knowledge",
    f"""SELECT person_id, part, first_session, 't' || (size % 7) AS tags, 'm ' || size AS memories, 'ok' AS status
        FROM ({_KNOWN})""",
    "mentions", "order_sessions",
)
oracle(
    "knowledge_metrics",
    f"""SELECT count(DISTINCT person_id) AS people_processed, count(*) AS tags_offered,
        count(DISTINCT (person_id, size % 7)) AS tags_inserted, count(*) AS memories_inserted, CAST(0 AS BIGINT) AS people_failed,
        CAST(NULL AS VARCHAR) AS last_error, CAST(0 AS BIGINT) AS last_run FROM ({_KNOWN})""",
    "mentions", "order_sessions",
)

# --- statistics ----------------------------------------------------------------------------

_STOP = "[" + ", ".join(lit(w) for w in K.STOPWORDS) + "]"


def _grams(source: str) -> dict[str, str]:
    bare = f"translate(lower(content), {lit(K.TERM_PUNCTUATION)}, '')"
    follow = "lead(w, {n}) OVER (PARTITION BY chat_id, line_number ORDER BY i)"
    return {
        "split_words": f"""SELECT chat_id, sender, timestamp, line_number, content, list_filter(
            regexp_split_to_array({bare}, '{SPACE}+'), lambda w: {u16('w')} >= 2 AND NOT list_contains({_STOP}, w)) AS ws
            FROM {source} WHERE type = 'text'""",
        "single": """SELECT chat_id, sender, timestamp, line_number, unnest(range(0, len(ws))) AS i, unnest(ws) AS w
            FROM split_words""",
        "follows": f"SELECT *, {follow.format(n=1)} AS w2, {follow.format(n=2)} AS w3 FROM single",
        "grams": f"""SELECT chat_id, sender, timestamp, line_number, term FROM (
            SELECT *, w AS term FROM follows UNION ALL
            SELECT *, w || ' ' || w2 FROM follows WHERE w2 IS NOT NULL UNION ALL
            SELECT *, w || ' ' || w2 || ' ' || w3 FROM follows WHERE w3 IS NOT NULL) WHERE {u16('term')} >= 3""",
        "by_sender": """SELECT chat_id, term, sender, count(*) AS n, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
            min((timestamp, line_number)) AS first_at FROM grams GROUP BY chat_id, term, sender""",
    }


def _term_stats(source: str) -> dict[str, str]:
    return {
        **_grams(source),
        "term_totals": f"""SELECT t.* FROM (SELECT chat_id, term, CAST(sum(n) AS BIGINT) AS total_count, min(first_seen) AS first_seen,
              max(last_seen) AS last_seen, min(first_at) AS first_at FROM by_sender GROUP BY chat_id, term) t
            JOIN (SELECT chat_id, count(*) AS messages FROM {source} GROUP BY chat_id) m USING (chat_id)
            WHERE total_count >= 3 AND total_count / messages <= 0.3 AND NOT regexp_matches(term, '^\\d+$')""",
        "term_stats": """SELECT t.*, b.sender AS top_sender, b.n AS top_count FROM term_totals t JOIN (
            SELECT *, row_number() OVER (PARTITION BY chat_id, term ORDER BY n DESC, first_at) AS r FROM by_sender) b
            ON b.chat_id = t.chat_id AND b.term = t.term AND b.r = 1""",
    }


def _samples(k: int) -> dict[str, str]:
    return {
        "top_terms": _top("term_stats", "total_count DESC, term", k, "chat_id"),
        "sampled": """SELECT chat_id, term, trank, sample, CAST(row_number() OVER (PARTITION BY chat_id, term ORDER BY first_place, sha256(sample)) AS INTEGER)
              AS sample_no FROM (
            SELECT g.chat_id, g.term, max(t.rank) AS trank, '[' || g.sender || ']: ' || s.content AS sample,
              min((g.timestamp, g.line_number)) AS first_place
            FROM grams g JOIN top_terms t ON t.chat_id = g.chat_id AND t.term = g.term
            JOIN split_words s ON s.chat_id = g.chat_id AND s.timestamp = g.timestamp AND s.line_number = g.line_number
            GROUP BY g.chat_id, g.term, '[' || g.sender || ']: ' || s.content) QUALIFY sample_no <= 5""",
    }


_PAIRS = """SELECT a.chat_id, a.term AS term_a, b.term AS term_b, a.trank AS rank_a, b.trank AS rank_b, count(*) AS count
    FROM sampled a JOIN sampled b ON b.chat_id = a.chat_id AND b.sample = a.sample AND b.trank > a.trank
    WHERE NOT contains(a.term, b.term) AND NOT contains(b.term, a.term) GROUP BY ALL"""
oracle("sender_terms", "SELECT * EXCLUDE (first_at, first_seen) FROM by_sender", "messages", extra=_grams("messages"))
oracle("term_stats", "SELECT * EXCLUDE (first_at) FROM term_stats", "doc_messages", extra=_term_stats("doc_messages"))
oracle(
    "term_samples", "SELECT chat_id, term, sample_no, sha256(sample) AS sample FROM sampled", "doc_messages",
    extra={**_term_stats("doc_messages"), **_samples(3)},
)
oracle(
    "cooccurrence", f"SELECT chat_id, term_a, term_b, count FROM ({_PAIRS})", "doc_messages",
    extra={**_term_stats("doc_messages"), **_samples(15)},
)

# --- vectors -----------------------------------------------------------------------------------

_CENTERS = {
    "vecs": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "means": """SELECT label, place, avg(x) AS x FROM (
        SELECT label, unnest(range(0, len(v))) AS place, unnest(v) AS x FROM vecs) GROUP BY label, place""",
    "centers": """SELECT label, list(x / norm ORDER BY place) AS c FROM means
        JOIN (SELECT label, sqrt(sum(x * x)) AS norm FROM means GROUP BY label) USING (label) GROUP BY label""",
}
_ASSIGNED = """SELECT vec_id, label, CASE WHEN score >= 0.35 THEN topic END AS topic, score FROM (
    SELECT v.vec_id, v.label, c.label AS topic, list_cosine_similarity(v.v, c.c) AS score,
      row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_cosine_similarity(v.v, c.c), 12) DESC, c.label) AS r
    FROM vecs v, centers c) WHERE r = 1"""
oracle(
    "l2_normalize",
    """SELECT vec_id, place, round(coalesce(x / nullif(norm, 0), 0), 6) AS x FROM (
       SELECT vec_id, unnest(range(0, len(v))) AS place, unnest(v) AS x, sqrt(list_dot_product(v, v)) AS norm FROM (
       SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label * 2) AS v FROM embeddings))""",
)
oracle(
    "centroids", "SELECT label, unnest(range(0, len(c))) AS place, round(unnest(c), 6) AS x FROM centers", extra=_CENTERS,
)
oracle(
    "label_similarity",
    "SELECT vec_id, round(list_cosine_similarity(v, c), 6) AS similarity FROM vecs JOIN centers USING (label)", extra=_CENTERS,
)
oracle("nearest_centroid", f"SELECT vec_id, topic, round(score, 6) AS score FROM ({_ASSIGNED})", extra=_CENTERS)
_NEAR = {
    **_CENTERS,
    "near_vecs": _top(
        "(SELECT 'label-' || c.label AS query_id, vec_id, 1 - list_cosine_similarity(v, c) AS distance FROM vecs, centers c)",
        "round(distance, 12), vec_id", 10,
    ),
}
oracle("knn", "SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM near_vecs", extra=_NEAR)
oracle(
    "hybrid_search",
    "SELECT query_id, vec_id, round(combined, 6) AS combined, rank FROM (" + _top(
        """(SELECT query_id, vec_id, round(0.7 * coalesce(distance, 1.0) + 0.3 * coalesce(rank_value, 0.0), 12) AS combined
            FROM (SELECT query_id, vec_id, distance FROM near_vecs) FULL JOIN (SELECT query_id, doc_id AS vec_id, -score AS rank_value
              FROM top_docs) USING (query_id, vec_id))""",
        "combined, vec_id", 10,
    ) + ")",
    "queries",
    extra={
        **_NEAR,
        "asked": "SELECT 'label-' || (CAST(substr(query_id, 2, 2) AS INTEGER) - 1) AS query_id, keywords FROM queries",
        **_matching("documents", "doc_id", ["text"], "asked"),
        "top_docs": _top("scores", "score DESC, doc_id", 10),
    },
)
oracle(
    "relevant_chunks",
    "SELECT person_id, chunk_id, round(similarity, 6) AS similarity, rank FROM (" + _top(
        """(SELECT label AS person_id, vec_id AS chunk_id, list_cosine_similarity(v, c) AS similarity
            FROM vecs JOIN centers USING (label))""",
        "round(similarity, 12) DESC, chunk_id", 5, "person_id",
    ) + ")",
    extra=_CENTERS,
)
_TOPIC_NAMES = "[" + ", ".join(lit(k) for k, _, _ in K.TOPICS) + "]"
_TOPIC_LABELS = "[" + ", ".join(lit(n) for _, n, _ in K.TOPICS) + "]"
_SHARES = {
    **_CENTERS,
    "topics": f"SELECT 'src' || label AS chat_id, topic AS t, ({_TOPIC_NAMES})[topic + 1] AS topic FROM ({_ASSIGNED})",
    "shares": """SELECT chat_id, topic, t, count, total, format('{:.0f}', floor(count / total * 100 + 0.5)) AS pct FROM (
        SELECT chat_id, topic, any_value(t) AS t, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY chat_id) AS BIGINT) AS total
        FROM topics GROUP BY chat_id, topic) WHERE topic IS NOT NULL AND count >= 2""",
}
oracle("topic_share", "SELECT chat_id, topic, count, total, pct FROM shares", extra=_SHARES)
_DATE = "strftime(make_timestamp({} * 1000000), '%d/%m/%Y')"
oracle(
    "profile_facts",
    f"""SELECT t.chat_id AS contact_id, 'frequent_term' AS category,
        'O assunto ou termo "' || t.term || '" é mencionado frequentemente na conversa com ' || upper(t.chat_id) || '. Apareceu '
        || t.total_count || ' vezes. ' || t.top_sender || ' é quem mais fala sobre "' || t.term || '" (' || t.top_count
        || ' vezes). Período de citação: ' || {_DATE.format('t.first_seen')} || ' a ' || {_DATE.format('t.last_seen')}
        || '. Exemplo na conversa: ' || s.sample AS text, t.total_count AS evidence
        FROM top_terms t JOIN sampled s ON s.chat_id = t.chat_id AND s.term = t.term AND s.sample_no = 1
        UNION ALL
        SELECT chat_id, 'topic', upper(chat_id) || ' e o usuário conversam ativamente sobre ' || ({_TOPIC_LABELS})[t + 1]
        || '. Este assunto apareceu em aproximadamente ' || pct || '% das conversas (' || count || ' de ' || total || ' agrupamentos).',
        count FROM shares WHERE chat_id IN (SELECT source FROM documents)
        UNION ALL
        SELECT chat_id, 'co_occurrence', '"' || term_a || '" e "' || term_b || '" são assuntos que aparecem juntos frequentemente na conversa com '
        || upper(chat_id) || '. Isso ocorreu ' || count || ' vezes diferentes em períodos similares.', count FROM (
          SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY count DESC, rank_a, rank_b) AS r FROM (
            {_PAIRS.replace('FROM sampled a JOIN sampled b ON', 'FROM (SELECT * FROM sampled WHERE trank <= 15) a JOIN (SELECT * FROM sampled WHERE trank <= 15) b ON')})) WHERE r <= 5""",
    "doc_messages", extra={**_term_stats("doc_messages"), **_samples(20), **_SHARES},
)

# --- answering context ---------------------------------------------------------------------------

_DATED_TEXT = f"coalesce({iso('start_time')}, '')"
_RULE_HEAD, _RULE_REST = K.DATE_RULE.split("{lo}")
_RULE_MIDDLE, _RULE_TAIL = _RULE_REST.split("{hi}")
oracle(
    "context_prompts",
    f"""SELECT r.query_id, {lit(K.SYSTEM_PROMPT)} || CASE WHEN min(start_time) IS NOT NULL THEN {lit(_RULE_HEAD)} || {day('min(start_time)')}
          || {lit(_RULE_MIDDLE)} || {day('max(start_time)')} || {lit(_RULE_TAIL)} ELSE '' END AS system_prompt,
        {lit(K.USER_PROMPT_HEAD)} || string_agg('[' || {_DATED_TEXT} || ' - ' || sender || ']: ' || content, chr(10) || chr(10) ORDER BY rank)
          || {lit(K.USER_PROMPT_QUESTION)} || any_value(q.text) || {lit(K.USER_PROMPT_TAIL)} AS user_prompt
        FROM results r JOIN queries q ON q.query_id = r.query_id GROUP BY r.query_id""",
    *_ROUTED_VIEWS, extra=_routed_parts(False),
)
_ASKED = {
    "texts_asked": "SELECT DISTINCT sha256(text) AS query_id, text FROM questions",
    "asked_at": "SELECT query_id, text, CAST(883656000 AS BIGINT) AS moment FROM texts_asked", **_DATE_STEPS,
    "classified": _classified("texts_asked"), "synonyms": _SYNONYMS, "expanded": _EXPANDED,
    "queries": """SELECT c.query_id, c.text, c.intent, list_filter(coalesce(x.keywords, []), lambda w: w IS NOT NULL) AS keywords,
        r.date_from, r.date_to, CAST(NULL AS VARCHAR) AS chat_id
        FROM classified c JOIN expanded x USING (query_id) JOIN question_ranges r USING (query_id)""",
    **_routed_parts(True),
}
oracle(
    "ask_questions",
    f"""SELECT w.query_id, q.intent, q.date_from, q.date_to, coalesce(p.results, 0) AS results, p.system_prompt, p.user_prompt FROM questions w
        JOIN queries q ON q.text = w.text LEFT JOIN (
          SELECT r.query_id, count(*) AS results, {lit(K.SYSTEM_PROMPT)} || CASE WHEN min(start_time) IS NOT NULL THEN {lit(_RULE_HEAD)} || {day('min(start_time)')}
              || {lit(_RULE_MIDDLE)} || {day('max(start_time)')} || {lit(_RULE_TAIL)} ELSE '' END AS system_prompt,
            {lit(K.USER_PROMPT_HEAD)} || string_agg('[' || {_DATED_TEXT} || ' - ' || sender || ']: ' || content, chr(10) || chr(10) ORDER BY rank)
              || {lit(K.USER_PROMPT_QUESTION)} || any_value(q.text) || {lit(K.USER_PROMPT_TAIL)} AS user_prompt
          FROM results r JOIN queries q ON q.query_id = r.query_id GROUP BY r.query_id) p ON p.query_id = q.query_id""",
    "messages", "chats", "entities", "order_sessions", "questions", extra=_ASKED,
)
oracle(
    "fixed_answers",
    f"SELECT query_id, {lit(K.NO_CONTEXT_ANSWER)} AS answer FROM queries WHERE query_id NOT IN (SELECT query_id FROM results)",
    *_ROUTED_VIEWS, extra=_routed_parts(False),
)
oracle(
    "fallback_answers",
    f"""SELECT query_id, {lit(K.FAILED_ANSWER)} || string_agg(chr(10) || '[' || n || '] ' || {_DATED_TEXT} || ' ' || sender || ': ' || content, '' ORDER BY n) AS answer
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM results) GROUP BY query_id""",
    *_ROUTED_VIEWS, extra=_routed_parts(False),
)
oracle(
    "citations",
    f"""SELECT query_id, rank, '[' || {_DATED_TEXT} || '] ' || chat_name || ' — ' ||
        CASE WHEN sender = 'System' THEN 'Root' ELSE sender END AS meta FROM results""",
    *_ROUTED_VIEWS, extra=_routed_parts(False),
)

# --- dashboard -------------------------------------------------------------------------------------

_TOP_PEOPLE = "SELECT id FROM people ORDER BY message_count DESC, id LIMIT {n}"
oracle(
    "home_totals",
    f"""SELECT (SELECT count(*) FROM chats) AS chat_count, (SELECT CAST(sum(message_count) AS BIGINT) FROM chats) AS message_count,
        (SELECT count(*) FROM people) AS people_count,
        (SELECT count(*) FROM tags WHERE person_id IN ({_TOP_PEOPLE.format(n=5)})) AS tag_count,
        (SELECT count(*) FROM memories WHERE person_id IN ({_TOP_PEOPLE.format(n=5)})) AS memory_count""",
    "chats", "people", "tags", "memories",
)
oracle(
    "featured_people",
    f"""SELECT p.id, upper(left(array_to_string(list_transform(string_split(name, ' '), lambda w: left(w, 1)), ''), 2)) AS initials,
        split_part(name, ' ', 1) AS name, message_count, coalesce(t.tags, '') AS tags FROM people p LEFT JOIN (
          SELECT person_id, string_agg(tag, ', ' ORDER BY r) AS tags FROM (SELECT *, row_number() OVER
            (PARTITION BY person_id ORDER BY created_at, tag) AS r FROM tag_rows) WHERE r <= 2 GROUP BY person_id) t
        ON t.person_id = p.id WHERE p.id IN ({_TOP_PEOPLE.format(n=3)})""",
    "people", "tag_rows",
)
oracle(
    "recent_chats",
    "SELECT id, name, message_count, last_message_at FROM chats ORDER BY coalesce(last_message_at, 0) DESC, id LIMIT 3", "chats",
)
oracle(
    "relative_time",
    """SELECT chat_id, line_number, CASE WHEN m < 1 THEN 'agora' WHEN m < 60 THEN m || 'min atrás'
       WHEN m // 60 < 24 THEN (m // 60) || 'h atrás' WHEN m // 1440 < 7 THEN (m // 1440) || 'd atrás'
       ELSE strftime(make_timestamp(timestamp * 1000000), '%d') || ' de ' || (['jan.', 'fev.', 'mar.', 'abr.', 'mai.', 'jun.',
         'jul.', 'ago.', 'set.', 'out.', 'nov.', 'dez.'])[month(make_timestamp(timestamp * 1000000))] END AS label
       FROM (SELECT *, CAST(floor((1705604800 - timestamp) / 60.0) AS BIGINT) AS m FROM messages)""",
    "messages",
)
oracle(
    "person_cards",
    """SELECT p.id, p.name, upper(left(array_to_string(list_transform(string_split(p.name, ' '), lambda w: left(w, 1)), ''), 2)) AS initials,
       message_count, kind, page, items FROM people p LEFT JOIN (
         SELECT person_id, kind, (pos - 1) // 5 AS page, string_agg(item, '; ' ORDER BY pos) AS items FROM (
           SELECT *, row_number() OVER (PARTITION BY person_id, kind ORDER BY created_at, item) AS pos FROM (
             SELECT person_id, 'tag' AS kind, tag AS item, created_at FROM tag_rows UNION ALL
             SELECT person_id, 'memory', memory, created_at FROM memories)) GROUP BY ALL) i ON i.person_id = p.id""",
    "people", "tag_rows", "memories",
)
oracle("node_weights", "SELECT id, 22 + least(message_count / 500, 14.0::DOUBLE) AS weight FROM people", "people")
oracle(
    "pivot_flags",
    "SELECT chat_id, line_number, contains(content, split_part(content, ' ', 1)) AS is_pivot FROM messages", "messages",
)

# --- analytics -----------------------------------------------------------------------------------

oracle(
    "activity",
    f"""SELECT chat_id, sender, {day('timestamp')} AS day, (timestamp // 3600) % 24 AS hour, count(*) AS message_count,
        CAST(sum({u16('content')}) AS BIGINT) AS characters FROM event_messages GROUP BY ALL""",
    "event_messages",
)
oracle(
    "activity_rollup",
    """SELECT chat_id, sender, count(*) AS message_count, CAST(grouping(chat_id, sender) AS BIGINT) AS level
       FROM event_messages GROUP BY ROLLUP (chat_id, sender)""",
    "event_messages",
)


def _relations(members: str) -> dict[str, str]:
    return {
        "members": f"SELECT DISTINCT c, p FROM ({members})",
        "pairs": """SELECT a.p AS source_id, b.p AS target_id, count(*) AS shared FROM members a JOIN members b
            ON a.c = b.c AND a.p < b.p GROUP BY ALL""",
        "edges": "SELECT *, round(shared / (SELECT max(shared) FROM pairs), 6) AS strength FROM pairs",
    }


_SUPPLIERS = _relations("SELECT l_orderkey AS c, l_suppkey AS p FROM lineitem")
oracle("relations", "SELECT * FROM edges", extra=_SUPPLIERS)
oracle("all_relations", "SELECT source_id, target_id, 'co_occurrence' AS relation_type, strength FROM edges", extra=_SUPPLIERS)
oracle(
    "strong_relations",
    """SELECT source_id, target_id, strength, a.d AS source_degree, b.d AS target_degree FROM strong
       JOIN degrees a ON a.p = source_id JOIN degrees b ON b.p = target_id""",
    extra={
        **_SUPPLIERS,
        "strong": "SELECT * FROM edges WHERE strength >= 0.5",
        "degrees": "SELECT p, count(*) AS d FROM (SELECT unnest([source_id, target_id]) AS p FROM strong) GROUP BY p",
    },
)
oracle("graph_edges", "SELECT source_id AS a, target_id AS b, strength FROM edges", extra=_SUPPLIERS)
oracle(
    "window_relations", "SELECT * FROM edges", "event_messages",
    extra=_relations("SELECT chat_id || '|' || (timestamp // 86400) AS c, sender AS p FROM event_messages WHERE type <> 'system'"),
)
oracle(
    "name_variants",
    """SELECT a.n AS name_a, b.n AS name_b, levenshtein(a.n, b.n) AS distance FROM names a JOIN names b
       ON a.n < b.n AND levenshtein(a.n, b.n) <= 2""",
    extra={"names": "SELECT DISTINCT lower(s_name) AS n FROM supplier"},
)
oracle(
    "label_variants",
    """SELECT a.n AS name_a, b.n AS name_b, levenshtein(a.n, b.n) AS distance FROM names a JOIN names b
       ON a.n < b.n AND abs(length(a.n) - length(b.n)) <= 2 AND levenshtein(a.n, b.n) <= 2""",
    extra={"names": "SELECT DISTINCT lower(replace(p_name, ' ', '')) AS n FROM part"},
)
oracle(
    "relations_in_period",
    """SELECT source_id, target_id, shared, round(shared / max(shared) OVER (), 6) AS strength FROM (
        SELECT a.l_suppkey AS source_id, b.l_suppkey AS target_id, count(DISTINCT a.l_orderkey) AS shared FROM inside a JOIN inside b
        ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)""",
    extra={"inside": """SELECT l_orderkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation ON n_nationkey = s_nationkey WHERE year(o_orderdate) IN (1995, 1996) AND n_regionkey IN (1, 3)"""},
)
oracle(
    "event_timeline",
    """SELECT event, CAST(min(a) AS VARCHAR) AS first_day, CAST(max(b) AS VARCHAR) AS last_day, count(*) AS mentions FROM (
        SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event ORDER BY a, b, n) AS island FROM (
          SELECT *, max(b) OVER (PARTITION BY event ORDER BY a, b, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
            SELECT source AS event, s.a AS a, s.b AS b, row_number() OVER () AS n
            FROM placed_dates JOIN documents ON CAST(doc_id AS VARCHAR) = query_id WHERE s.a IS NOT NULL AND source IS NOT NULL)))
      GROUP BY event, island""",
    "questions", extra={"asked_at": "SELECT query_id, text, 883656000 - CAST(query_id AS BIGINT) * 40009 AS moment FROM questions", **_DATE_STEPS},
)
oracle(
    "inbox_after_changes",
    """SELECT chat_id, mention, moment, line, alias FROM log l WHERE op = 2
        AND NOT EXISTS (SELECT 1 FROM log x WHERE x.op > 0 AND x.chat_id = l.chat_id AND x.mention = l.mention AND (x.moment, x.line, x.op) > (l.moment, l.line, l.op))
        AND NOT EXISTS (SELECT 1 FROM log x WHERE x.op = 0 AND x.chat_id = l.chat_id AND (x.moment, x.line, x.op) > (l.moment, l.line, l.op))""",
    extra={
        "puts": "SELECT o_custkey AS chat_id, o_orderkey % 50 AS mention, CAST(epoch(o_orderdate) AS BIGINT) AS moment, o_orderkey AS line, o_orderpriority AS alias FROM orders",
        "log": """SELECT 2 AS op, * FROM puts UNION ALL SELECT 1, chat_id, mention, moment + 86400, line, alias FROM puts WHERE line % 3 = 0
            UNION ALL SELECT 0, chat_id, mention, moment, line, alias FROM puts WHERE alias = '1-URGENT' AND line % 7 = 0""",
    },
)
oracle(
    "profile_tables_after_changes",
    """SELECT kind, contact_id, place, moment, text FROM (
        SELECT *, max(CASE WHEN op = 0 THEN moment END) OVER (PARTITION BY kind, contact_id) AS wiped,
          row_number() OVER (PARTITION BY kind, contact_id, place, op = 0 ORDER BY moment DESC, op DESC, text DESC) AS n FROM log)
      WHERE op = 2 AND n = 1 AND (wiped IS NULL OR (moment, op) > (wiped, 0))""",
    extra={"log": """SELECT CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS op,
        ['fact', 'block', 'profile'][l_linenumber % 3 + 1] AS kind, l_suppkey AS contact_id, l_linenumber AS place, l_orderkey AS moment, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS text FROM lineitem"""},
)
_PROBED = " UNION ALL ".join(
    f"SELECT {i} AS topic_order, {lit(topic)} AS topic, {lit(label)} AS label, {lit(probe)} AS probe" for i, (topic, label, probes) in enumerate(K.TOPICS) for probe in probes)


def _hashed(rows: str, keys: str, text: str) -> str:
    """Unit vectors of letter runs by their hash, one row per filled dimension."""
    return f"""SELECT {keys}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS x FROM (
        SELECT {keys}, CAST('0x' || substr(md5(run), 1, 4) AS INTEGER) % 64 AS slot, CAST(count(*) AS DOUBLE) AS n FROM (
          SELECT {keys}, substr(t, unnest(range(1, length(t) - 1)), 3) AS run FROM (
            SELECT {keys}, ' ' || array_to_string({terms(text)}, ' ') || ' ' AS t FROM {rows})) GROUP BY ALL)"""


oracle(
    "session_topics",
    """SELECT session_id, CASE WHEN best.s >= 0.3 THEN topic END AS topic, CASE WHEN best.s >= 0.3 THEN label END AS label, round(best.s, 6) AS score FROM (
        SELECT session_id, max({'s': score, 'o': -topic_order}) AS best FROM (
          SELECT session_id, topic_order, round(sum(t.x * c.x) / any_value(c.size), 12) AS score FROM told t JOIN sized_centers c USING (slot) GROUP BY session_id, topic_order)
        GROUP BY session_id) JOIN (SELECT DISTINCT topic_order, topic, label FROM probes) ON topic_order = -best.o""",
    "gap_rows",
    extra={
        "probes": _PROBED, "transcripts": _gap_transcripts(), "probe_vectors": _hashed("probes", "topic_order, probe", "probe"),
        "topic_centers": """SELECT topic_order, slot, sum(x) / (SELECT count(*) FROM probes q WHERE q.topic_order = v.topic_order) AS x
            FROM probe_vectors v GROUP BY topic_order, slot""",
        "sized_centers": "SELECT *, sqrt(sum(x * x) OVER (PARTITION BY topic_order)) AS size FROM topic_centers",
        "told": _hashed("transcripts", "session_id", "transcript"),
    },
)
oracle(
    "unify_names",
    """SELECT CASE WHEN split_part(normalized_name, ' ', 1) IN ('hot', 'cold') THEN split_part(normalized_name, ' ', 1)
       ELSE normalized_name END AS canonical_name, count(*) AS n FROM entities GROUP BY 1""",
    "entities",
)
_CACHE = "SELECT text AS query_text, min(query_id) AS llm_response, count(*) AS hit_count FROM questions WHERE text LIKE '%src1%' GROUP BY text"
oracle("query_cache", _CACHE, "questions")
oracle(
    "cached_results",
    f"SELECT query_id, llm_response FROM questions LEFT JOIN ({_CACHE}) ON query_text = text", "questions",
)
oracle(
    "search_history",
    """SELECT text AS query, count(*) AS times, CAST(sum(CASE WHEN text LIKE '%src1%' THEN 1 ELSE 0 END) AS BIGINT) AS results
       FROM questions GROUP BY text""",
    "questions",
)
oracle(
    "extracted_items",
    " UNION ALL ".join(
        f"SELECT doc_id AS line_number, '{kind}' AS kind, unnest(regexp_extract_all(text, {lit(pattern)})) AS value FROM documents"
        for kind, pattern in [
            ("link", analytics.LINK), ("email", analytics.EMAIL), ("phone", analytics.PHONE), ("date", analytics.DATE),
        ]
    ),
)
_BLOCKS = f"""SELECT chat_id AS contact_id, (pos - 1) // 50 AS block_index, {day('min(timestamp)')} AS start_date,
    {day('max(timestamp)')} AS end_date, count(*) AS message_count FROM (SELECT *, row_number() OVER
    (PARTITION BY chat_id ORDER BY timestamp, line_number) AS pos FROM event_messages) GROUP BY chat_id, (pos - 1) // 50"""
oracle("message_blocks", _BLOCKS, "event_messages")
oracle(
    "contact_profiles",
    f"""SELECT contact_id, CAST(sum(message_count) AS BIGINT) AS message_count, min(start_date) AS date_range_start,
        max(end_date) AS date_range_end, count(*) AS block_count FROM ({_BLOCKS}) GROUP BY contact_id""",
    "event_messages",
)
oracle(
    "usage_metrics",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50,
       quantile_disc(value, 0.95) AS p95, max(value) AS largest FROM events GROUP BY event_type""",
)

# --- streams -----------------------------------------------------------------------------------------

# A stream is ended after its last file, so it tells what a batch over all rows tells.
_EVENT_GAPS = VIEWS["gap_rows"].replace("FROM messages", "FROM event_messages")
oracle(
    "stream_gap_sessions",
    f"""SELECT chat_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS message_count
        FROM event_gaps GROUP BY chat_id, seg""",
    "event_messages", extra={"event_gaps": _EVENT_GAPS},
)
oracle(
    "stream_budget_sessions",
    """SELECT chat_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS message_count
       FROM cut GROUP BY chat_id, seg""",
    "event_messages", recursive=True, extra=_budget("event_messages", 86400, 40),
)
oracle(
    "stream_window_counts",
    """SELECT s AS window_start, s + 3600 AS window_end, sender, count(*) AS message_count FROM (
       SELECT sender, timestamp // 3600 * 3600 AS s FROM event_messages) GROUP BY s, sender""",
    "event_messages",
)
oracle(
    "stream_sliding_counts",
    """SELECT s AS window_start, s + 3600 AS window_end, sender, count(*) AS message_count FROM (
       SELECT sender, timestamp // 900 * 900 - 900 * unnest(range(0, 4)) AS s FROM event_messages) GROUP BY ALL""",
    "event_messages",
)
oracle("stream_distinct_messages", "SELECT DISTINCT chat_id, timestamp, sender, content FROM event_messages", "event_messages")
oracle(
    "stream_pending_feed",
    """SELECT CAST(o_orderkey AS VARCHAR) AS session_id, format('Customer#{:09d}', o_custkey * 2) AS alias, o_orderpriority AS context
       FROM orders WHERE o_orderstatus <> 'P' AND format('Customer#{:09d}', o_custkey * 2) NOT IN (SELECT c_name FROM customer)""",
)
oracle(
    "stream_knowledge",
    f"SELECT DISTINCT person_id, 't' || (size % 7) AS tag, 'map_reduce' AS source FROM ({_KNOWN})", "mentions", "order_sessions",
)
