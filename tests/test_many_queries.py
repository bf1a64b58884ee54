"""Many queries at once: what they have in common is matched and ranked once."""

import random

import pytest

from chatloom.operators import search as Q


@pytest.mark.parametrize("most", [1, 3])
def test_first_of_many_queries_are_those_of_each_alone(spark, monkeypatch, most):
    draw = random.Random(5)
    words = ["the", "then", "of", "gato", "gata", "rio", "x1"]
    say = lambda n: " ".join(draw.choices(words, [9, 3, 6, 2, 1, 1, 1], k=n))
    said = [(draw.choice(["a", "b", None]), draw.randrange(5), i % 7, say(draw.randrange(1, 9)), say(2)) for i in range(150)]
    docs = Q.tokenized(spark.createDataFrame(said + said[:20], "chat string, at long, line long, a string, b string"), ["chat", "at", "line"], ["a", "b"])
    asked = [(f"q{i % 50}", [say(draw.randrange(1, 3)), draw.choice(["th", "the", "ga", "o"])]) for i in range(60)]
    asked += [("same", ["the", "the"]), ("three", ["the", "of", "gat"]), ("rare", ["x1"]), ("none", ["zz"]), (None, ["the"])]
    wanted = Q.phrases(spark.createDataFrame(asked, "query_id string, keywords array<string>"))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    first = lambda df: rows(Q.top_k(df, ["query_id"], [Q.F.desc("score"), "chat", "at", "line"], most))
    alone = first(Q.bm25(docs, ["chat", "at", "line"], wanted))
    matched = []
    hits = Q.phrase_hits
    monkeypatch.setattr(Q, "phrase_hits", lambda d, k, w: matched.append(w) or hits(d, k, w))
    shared = Q.bm25(docs, ["chat", "at", "line"], wanted, most)
    assert first(shared) == alone and shared.count() == len(alone)
    assert matched[0].count() < wanted.count() / 2


def test_slices_of_documents_give_the_same_first_ones(spark, monkeypatch):
    """Before, every document that fits a question was shuffled for it."""
    draw = random.Random(9)
    words = ["the", "then", "of", "gato", "gata", "rio"]
    say = lambda n: " ".join(draw.choices(words, [9, 3, 6, 2, 1, 1], k=n))
    said = [(draw.choice(["a", "b", None]), draw.randrange(4), i % 5, say(draw.randrange(1, 6))) for i in range(90)]
    keys = ["chat", "at", "line"]
    docs = Q.tokenized(spark.createDataFrame(said + said[:30], "chat string, at long, line long, a string"), keys, ["a"])
    asked = [(f"q{i}", [say(draw.randrange(1, 3)), draw.choice(["th", "the", "ga", "o"]), say(1)]) for i in range(20)]
    wanted = Q.phrases(spark.createDataFrame(asked, "query_id string, keywords array<string>"))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    alone = rows(Q.top_k(Q.bm25(docs, keys, wanted), ["query_id"], [Q.F.desc("score"), *keys], 2).drop("rank"))
    # Cells are few scores and few parts; a filter that all pass.
    monkeypatch.setattr(Q, "SLICE_SCORES", 40)
    monkeypatch.setattr(Q, "SLICE_PARTS", 9)
    monkeypatch.setattr(Q, "MOST_SLOTS", 64)
    shared = Q.bm25(docs, keys, wanted, 2)
    assert rows(shared) == alone and len(alone) > 30
    assert "FlatMapCoGroupsInArrow" in shared._jdf.queryExecution().toString()


def test_entities_meet_sessions_once(spark):
    """Before, an entity went to its session with its texts, once for every query it is for."""
    entities = [("s1", "Rio Azul", "rio azul", "place", "seen"), ("s1", "Rio Azul", "rio azul", "place", "seen"),
                ("s2", "Gato", "gato", "animal", "rio"), ("s9", "Rio", "rio", "place", "seen"), ("s2", "Rio", None, "place", "seen")]
    sessions = [("s1", 100, 200), ("s2", 300, 400), ("s2", 300, 500)]
    asked = [("q1", ["rio"], 0, 0), ("q2", ["rio"], 250, 450), ("q3", ["gat"], None, None), ("q4", ["nada"], 0, 0)]
    found = Q.search_aggregation(
        spark.createDataFrame(asked, "query_id string, keywords array<string>, date_from long, date_to long"),
        spark.createDataFrame(entities, "session_id string, name string, normalized_name string, type string, action string"),
        spark.createDataFrame(sessions, "id string, start_time long, end_time long"))
    assert {tuple(r) for r in found.select("query_id", "rank", "name", "type", "count").collect()} == {
        ("q1", 1, "gato", "animal", 2), ("q1", 2, "rio azul", "place", 2), ("q2", 1, "gato", "animal", 1), ("q3", 1, "gato", "animal", 2)}
    assert "(__text" in found._jdf.queryExecution().optimizedPlan().toString()


def test_equal_keywords_of_factual_questions_meet_once(spark, monkeypatch):
    """Before, every question's own keywords met all messages."""
    said = [("a", "ana", f"gato rio {i}", i, "text", i) for i in range(30)]
    messages = spark.createDataFrame(said, "chat_id string, sender string, content string, timestamp long, type string, line_number long")
    asked = spark.createDataFrame([(f"q{i}", ["gato"], 0, 0, None) for i in range(9)], "query_id string, keywords array<string>, date_from long, date_to long, chat_id string")
    matched = []
    hits = Q.phrase_hits
    monkeypatch.setattr(Q, "phrase_hits", lambda d, k, w: matched.append(w) or hits(d, k, w))
    told = Q.factual_pivots(asked, messages, limit=4)
    bounded = Q.factual_pivots(asked, messages, limit=4, bounded=True)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert [w.count() for w in matched] == [1, 9] and rows(told) == rows(bounded) and told.count() == 36
