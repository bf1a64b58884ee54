"""Work that makes far more rows than it reads is dealt to tasks by what it makes."""

from itertools import combinations

import pytest

from chatloom.operators import analytics, stats
from chatloom.session import dealt

MESSAGE = "chat_id string, sender string, content string, timestamp long, type string, line_number long"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_rare_terms_are_left_out_before_they_are_counted_by_text(spark):
    said = [("c", "ana", f"often rare{i}", 100 + i, "text", i) for i in range(200)] + [("d", "rui", "often", 1, "text", 1)]
    messages = spark.createDataFrame(said, MESSAGE)
    terms = stats._terms(messages)
    left = {(r.chat_id, r.term): r["count"] for r in stats._often(messages, terms, 3).groupBy("chat_id", "term").count().collect()}
    assert left[("c", "often")] == 200
    assert len(left) < 20
    assert "bit_get" in plan(stats.term_stats(messages))


def test_terms_of_null_chats_and_of_equal_rows(spark):
    row = ("c", "ana", "hello world", 5, "text", 1)
    said = [row] * 3 + [("c", "bob", "hello", 6, "text", 2), (None, "ana", "hello", 1, "text", 3)]
    said += [("c", "ana", f"filler{i}", 10 + i, "text", 10 + i) for i in range(20)]
    got = {tuple(r) for r in stats.term_stats(spark.createDataFrame(said, MESSAGE)).collect()}
    assert got == {
        ("c", "hello", 4, 5, 6, 1, "ana", 3), ("c", "world", 3, 5, 5, 1, "ana", 3), ("c", "hello world", 3, 5, 5, 1, "ana", 3)}


def test_tasks_follow_the_bytes(spark):
    few = dealt(spark.range(100), "id").rdd.getNumPartitions()
    many = dealt(spark.range(100), "id", size=10).rdd.getNumPartitions()
    assert few == spark.sparkContext.defaultParallelism and many > few


@pytest.mark.parametrize("block", [1000, 3])
def test_contexts_are_dealt_by_their_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(analytics, "CONTEXT_BLOCK", block)
    monkeypatch.setattr(analytics, "TASK_PAIRS", 2)
    members = {c: list(range(c, c + size)) for c, size in ((1, 2), (2, 5), (3, 11))}
    rows = spark.createDataFrame([(c, p) for c, people in members.items() for p in people] + [(None, 1), (1, None)], "context_id int, person_id int")
    shared = analytics.shared_contexts(rows)
    wanted = {}
    for people in members.values():
        for pair in combinations(people, 2):
            wanted[pair] = wanted.get(pair, 0) + 1
    assert {(r.source_id, r.target_id): r.shared for r in shared.collect()} == wanted
    assert "REPARTITION_BY_NUM" in plan(shared)


def test_names_with_a_common_prefix_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(analytics, "HOT_SEGMENT", 3)
    monkeypatch.setattr(analytics, "TASK_NAMES", 5)
    names = [f"member#000{i:03d}" for i in range(0, 90, 3)] + ["ana", "anna", "hanna", "a", "", "bob"]
    found = analytics.name_variants(spark.createDataFrame([(n,) for n in names * 2], "name string"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    told = sorted({n for n in names if n})
    wanted = {(a, b, distance(a, b)) for a, b in combinations(told, 2) if distance(a, b) <= 2}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert "REPARTITION_BY_NUM" in plan(found)
