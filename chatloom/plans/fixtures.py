"""Chat-shaped views over the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.extraction import QueryRules
from chatloom.session import pin_utc

# One row per kind of question: intents, the recent mark, an empty keyword list,
# a two-word keyword, accents, no match, date bounds.
QUERIES = [
    ("q01", "the", "factual", ["the"], 0, 0, None),
    ("q02", "of the", "factual", ["of the"], 0, 0, None),
    ("q03", "étion", "factual", ["étion", "queau"], 0, 0, None),
    ("q04", "keine treffer", "factual", ["zzzzqq"], 0, 0, None),
    ("q05", "heit ver", "unknown", [], 0, 0, None),
    ("q06", "user", "factual", ["user", "Ha!"], 0, 0, None),
    ("q07", "urgent", "narrative", ["urg"], 0, 0, None),
    ("q08", "low", "narrative", ["low", "1 urgent"], 852076800, 883612799, None),
    ("q09", "recent", "narrative", ["#RECENT#"], 0, 0, None),
    ("q10", "recent until", "narrative", ["#RECENT#"], 820454400, 883612799, None),
    ("q11", "ring", "aggregation", ["ring"], 0, 0, None),
    ("q12", "economy", "aggregation", ["economy", "small ri"], 820454400, 883612799, None),
]


# Ways to name a time, and the cues of the questions below.
DATES = [
    "ontem", "Anteontem", "hoje", "na semana passada", "no mês passado", "na última semana", "neste ano", "no ano passado",
    "nos últimos 3 dias", "nos últimos dois meses", "há duas semanas", "5 meses atrás", "na quinta-feira", "no sábado",
    "no fim de semana", "em março", "em outubro de 1997", "10 de maio de 1997", "29 de fevereiro", "de 01/02 a 05/02", "entre 3/4 e 10/9",
    "desde segunda", "até domingo", "antes de abril", "depois de 15/08/1996", "em 1996", "1997-02-30", "1997-12-01", "desde junho até ontem", "recentemente",
]
RULES = QueryRules(
    counting=("quantas vezes", "quantos", "ranking"), telling=("aconteceu", "novidades", "resumo"), recent=("recente", "ultimamente"),
    filler=("o", "a", "que", "de", "em", "no", "na", "nos", "ate", "entre", "e", "quantas", "vezes", "apareceu", "aconteceu", "novidades", "onde", "esta", "recentemente"),
)


def query_values(array: str) -> str:
    """The queries as SQL rows; `array` is the engine's form of a list, with {}."""
    def text(v):
        return "CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'"

    def words(ks):
        return array.format(", ".join(text(k) for k in ks))

    rows = [
        f"({text(i)}, {text(t)}, {text(n)}, {words(ks)}, CAST({lo} AS BIGINT), CAST({hi} AS BIGINT), {text(c)})"
        for i, t, n, ks, lo, hi, c in QUERIES
    ]
    return (
        "SELECT * FROM (VALUES " + ", ".join(rows)
        + ") AS v(query_id, text, intent, keywords, date_from, date_to, chat_id)"
    )


class Tables:
    """The given tables of one folder and the views made from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = pin_utc(spark)
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def messages(self) -> DataFrame:
        return self.read("conversations").selectExpr(
            "CAST(conv_id AS STRING) AS chat_id", "role AS sender", "text AS content",
            "1704067200 + conv_id*604800 + turn*600*(1 + conv_id % 20) AS timestamp",
            "CASE WHEN role = 'system' THEN 'system' ELSE 'text' END AS type",
            "turn AS line_number",
        )

    @cached_property
    def event_messages(self) -> DataFrame:
        return self.read("events").selectExpr(
            "CAST(user_id AS STRING) AS chat_id", "event_type AS sender", "props AS content",
            "unix_seconds(CAST(ts AS TIMESTAMP)) AS timestamp", "'text' AS type",
            "event_id AS line_number",
        )

    @cached_property
    def doc_messages(self) -> DataFrame:
        return self.read("documents").selectExpr(
            "source AS chat_id", "lang AS sender", "text AS content",
            "1704067200 + doc_id*60 AS timestamp", "'text' AS type", "doc_id AS line_number",
        )

    @cached_property
    def chats(self) -> DataFrame:
        from chatloom.operators.store import chat_rows

        return chat_rows(self.messages)

    @cached_property
    def order_sessions(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "CAST(o_orderkey AS STRING) AS id", "CAST(o_custkey AS STRING) AS chat_id",
            "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS start_time",
            "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) + 86400 AS end_time",
            "o_orderpriority AS summary",
        )

    @cached_property
    def entities(self) -> DataFrame:
        lines, parts = self.read("lineitem"), self.read("part")
        return lines.join(parts, lines.l_partkey == parts.p_partkey).selectExpr(
            "CAST(l_orderkey*10 + l_linenumber AS STRING) AS id",
            "CAST(l_orderkey AS STRING) AS session_id", "p_name AS name",
            "lower(trim(p_name)) AS normalized_name", "lower(p_type) AS type",
            "l_returnflag AS action",
        )

    @cached_property
    def people(self) -> DataFrame:
        counts = self.read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
        customers = self.read("customer")
        return customers.join(counts, customers.c_custkey == counts.o_custkey, "left").selectExpr(
            "CAST(c_custkey AS STRING) AS id", "c_name AS name",
            "coalesce(n, 0) AS message_count",
        )

    @cached_property
    def mentions(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "CAST(o_orderkey AS STRING) AS session_id", "CAST(o_custkey AS STRING) AS person_id",
            "o_orderpriority AS context", "o_orderstatus = 'F' AS processed",
        )

    @cached_property
    def tags(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "CAST(o_custkey AS STRING) AS person_id", "lower(o_orderpriority) AS tag",
            "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS created_at",
        )

    @cached_property
    def memories(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "CAST(o_custkey AS STRING) AS person_id",
            "concat('  pedido ', CAST(o_orderkey AS STRING), ' ') AS memory",
            "CAST(o_orderkey AS STRING) AS session_id",
            "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS created_at",
        )

    @cached_property
    def extracted(self) -> DataFrame:
        """Extraction results: one mention per order."""
        orders, customers = self.read("orders"), self.read("customer")
        return orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr(
            "CAST(o_orderkey AS STRING) AS session_id",
            """array(named_struct(
                'name', CASE o_orderstatus WHEN 'F' THEN upper(c_name)
                        WHEN 'O' THEN concat('Guest ', c_mktsegment) ELSE c_name END,
                'type', CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'person' END,
                'context', o_orderpriority,
                'sentiment', 'neutral',
                'is_participant', o_orderpriority = '1-URGENT')) AS mentioned_entities""",
        )

    @cached_property
    def pending(self) -> DataFrame:
        orders, customers = self.read("orders"), self.read("customer")
        return orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr(
            "CAST(o_orderkey AS STRING) AS id", "CAST(o_custkey AS STRING) AS session_id",
            """CASE WHEN o_orderstatus = 'F' THEN concat(' ', c_mktsegment, o_orderpriority)
               ELSE lower(concat(c_mktsegment, o_orderpriority)) END AS alias""",
            "o_orderstatus AS context",
            "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) * 1000 AS timestamp",
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """One decision per alias, some of them faulty."""
        orders, customers = self.read("orders"), self.read("customer")
        chosen = (
            orders.join(customers, orders.o_custkey == customers.c_custkey)
            .groupBy("c_mktsegment", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
        )
        return chosen.selectExpr(
            "CASE WHEN c_mktsegment = 'FURNITURE' THEN concat('lost-', o_orderpriority) ELSE CAST(k AS STRING) END AS mention_id",
            """CASE c_mktsegment WHEN 'BUILDING' THEN 'create_new' WHEN 'AUTOMOBILE' THEN 'ignore'
               ELSE 'link_existing' END AS action""",
            "CASE WHEN c_mktsegment = 'MACHINERY' THEN '7' END AS person_id",
        )

    @cached_property
    def questions(self) -> DataFrame:
        """A question about each document's source, some of them about a time."""
        when = ", ".join(f"'{d}'" for d in DATES)
        return self.read("documents").selectExpr(
            "CAST(doc_id AS STRING) AS query_id",
            f"""CASE lang WHEN 'en' THEN concat('quantas vezes apareceu ', source, ' ', element_at(array({when}), CAST(doc_id % {len(DATES)} + 1 AS INT)))
               WHEN 'fr' THEN concat('o que aconteceu ', element_at(array({when}), CAST(doc_id % {len(DATES)} + 1 AS INT)), '?')
               WHEN 'de' THEN concat('Novidades de ', source, ' ring ', element_at(array({when}), CAST(doc_id % {len(DATES)} + 1 AS INT)))
               ELSE concat('onde está the ', source) END AS text""",
        )

    @cached_property
    def synonyms(self) -> DataFrame:
        """The languages of each source stand for its name."""
        return self.read("documents").filter("source IS NOT NULL").groupBy(F.lower("source").alias("keyword")).agg(
            F.sort_array(F.collect_set("lang")).alias("synonyms")
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Model answers in the shapes models give them."""
        return self.read("documents").selectExpr(
            "CAST(doc_id AS STRING) AS session_id",
            """CASE lang
               WHEN 'en' THEN concat('{"summary":"', source, '","mentioned_entities":[]}')
               WHEN 'fr' THEN concat('```json\n{"summary":"', source, '"}\n```')
               WHEN 'de' THEN concat('Sure: {"summary":"', source, '"} ok')
               ELSE concat('no braces ', source) END AS answer""",
        )

    @cached_property
    def memberships(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "l_orderkey AS context_id", "l_suppkey AS person_id"
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.spark.sql(query_values("CAST(array({}) AS ARRAY<STRING>)"))
