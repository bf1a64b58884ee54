import math
import re

import pytest
from pyspark.sql import functions as F

from chatloom.operators import search as Q

QUERY = "query_id string, text string, intent string, keywords array<string>, date_from long, date_to long, chat_id string"
DOCS = [
    (1, "O gato preto", "dorme no sofá"), (2, "gatos e ratos", "o gato preto corre"), (3, "nada", "preto gato"),
    (4, "gato", "preto"), (5, "um dois três quatro cinco", "um dois"),
]


def ask(spark, *keywords):
    return spark.createDataFrame([("q", "t", "factual", list(keywords), 0, 0, None)], QUERY)


def hits(spark, *keywords, **kw):
    docs = Q.tokenized(spark.createDataFrame(DOCS, "id long, a string, b string"), ["id"], ["a", "b"])
    rows = Q.phrase_hits(docs, ["id"], Q.phrases(ask(spark, *keywords), **kw)).collect()
    return sorted((r.kw_no, r.id, r.tf) for r in rows)


@pytest.mark.parametrize(
    "keywords, want",
    [
        (["gato"], [(0, 1, 1), (0, 2, 2), (0, 3, 1), (0, 4, 1)]),
        (["GÁTO PRE"], [(0, 1, 1), (0, 2, 1)]),  # in one field, in order, last word a prefix
        (["dois três quatro cin"], [(0, 5, 1)]),  # longer than the short form
        (["um dois", "zzz"], [(0, 5, 2)]),
        (["!!!", "no sofa"], [(0, 1, 1)]),
    ],
)
def test_phrases(spark, keywords, want):
    assert hits(spark, *keywords) == want


def test_joined_keyword_without_spaces(spark):
    assert hits(spark, "gato preto", keep_spaces=False) == []


def test_bm25_formula(spark):
    docs = Q.tokenized(spark.createDataFrame(DOCS, "id long, a string, b string"), ["id"], ["a", "b"])
    got = {r.id: r.score for r in Q.bm25(docs, ["id"], Q.phrases(ask(spark, "corre", "sofá"))).collect()}
    sizes = {i: len(re.findall(r"\w+", a + " " + b)) for i, a, b in DOCS}
    mean = sum(sizes.values()) / len(sizes)
    for i in (1, 2):
        idf = math.log((5 - 1 + 0.5) / 1.5)
        assert got[i] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * sizes[i] / mean)), abs=1e-6)
    assert set(got) == {1, 2}


def test_window_keeps_minute_neighbours(spark, messages):
    # 40 messages in one minute: the window is counted from the minute's ends.
    rows = [("c", "A", "alvo" if i == 20 else "x", 60 if 5 <= i < 45 else i if i < 5 else 100 + i, "text", i) for i in range(50)]
    got = Q.search_factual(ask(spark, "alvo"), messages(rows), window=2)
    assert sorted(r.line_number for r in got.collect()) == [5, 6, 7, 42, 43, 44]


def test_factual_filters_are_off_unless_asked(spark, messages):
    rows = [("c1", "A", "alvo", 10, "text", 0), ("c2", "A", "alvo", 20, "text", 0)]
    query = spark.createDataFrame([("q", "t", "factual", ["alvo"], 15, 0, None), ("r", "t", "factual", ["alvo"], 0, 0, "c1")], QUERY)
    pivots = lambda b: sorted((r.query_id, r.chat_id) for r in Q.factual_pivots(query, messages(rows), bounded=b).collect())
    assert len(pivots(False)) == 4
    assert pivots(True) == [("q", "c2"), ("r", "c1")]


def test_neighbours(spark, messages):
    rows = [("c", "A", f"m{i}", 100 + i, "text", i) for i in range(30)]
    sessions = spark.createDataFrame([("s", "c", 105, 120)], "id string, chat_id string, start_time long, end_time long")
    requests = spark.createDataFrame([("r1", "s", "M12"), ("r2", "s", "none")], "request_id string, session_id string, snippet string")
    got = {}
    for r in Q.neighbours(requests, sessions, messages(rows)).collect():
        got.setdefault(r.request_id, []).append(r.line_number)
    assert sorted(got["r1"]) == list(range(8, 17))
    assert sorted(got["r2"]) == list(range(5, 13))


def test_recent_is_oldest_first(spark):
    sessions = spark.createDataFrame([(f"s{i}", "c", i, i, "x") for i in range(9)], "id string, chat_id string, start_time long, end_time long, summary string")
    got = Q.search_recent(ask(spark, "#RECENT#"), sessions).orderBy("rank").collect()
    assert [r.start_time for r in got] == [4, 5, 6, 7, 8]


def test_suggestions(spark):
    terms = spark.createDataFrame([("gato", 3), ("gatos", 5), ("rato", 9)], "term string, occurrences long")
    prefixes = spark.createDataFrame([("Gá",), ("zz",)], "prefix string")
    got = Q.suggest(prefixes, terms).orderBy("rank").collect()
    assert [(r.prefix, r.term) for r in got] == [("ga", "gatos"), ("ga", "gato")]


def test_snippet_lines(spark):
    block = spark.createDataFrame([(1, "Ana Maria [10:00]: oi\ncontinua")], "id int, content string")
    got = Q.snippet_lines(block, ["id"]).orderBy("line_no").collect()
    assert [(r.sender, r.time, r.text, r["continues"]) for r in got] == [("Ana", "10:00", "oi", False), ("", "", "continua", True)]


def test_keywords_default_to_the_text(spark):
    from chatloom.functions import text as T

    df = ask(spark).select(T.keywords_or_text(F.col("keywords"), F.lit("all of it")).alias("k"))
    assert df.first()["k"] == ["all of it"]
