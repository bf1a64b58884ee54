import math
import random

import pytest

from chatloom.operators import sessions as S
from chatloom.operators.ordered import Ordered
from pyspark.sql import functions as F


def u16(s):
    return len(s.encode("utf-16-le")) // 2


def random_chats(seed, chats=6, size=60):
    rng = random.Random(seed)
    rows = []
    for c in range(chats):
        at = 1_700_000_000
        for i in range(rng.randint(1, size)):
            at += rng.choice([0, 0, 30, 599, 600, 601, 7199, 7200, 7201])
            text = rng.choice(["", "a", "é" * 3, "😀" * 2]) + "x" * rng.choice([0, 3, 4, 5, 39, 40, 41, 170])
            rows.append((f"c{c}", rng.choice("AB"), text, at, rng.choice(["text", "system"]), i))
    return rows


def by_chat(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[5])):
        out.setdefault(r[0], []).append(r)
    return out


def fold_sessions(rows, gap, budget):
    """Row after row, as the rule reads."""
    out = []
    for chat, ms in by_chat(rows).items():
        held, total = [], 0
        for m in ms:
            tokens = math.ceil(u16(m[2]) / 4)
            if held and (m[3] - held[-1][3] > gap or total + tokens > budget):
                out.append((chat, held[0][3], held[-1][3], len(held)))
                held, total = [], 0
            held.append(m)
            total += tokens
        out.append((chat, held[0][3], held[-1][3], len(held)))
    return sorted(out)


def fold_chunks(rows, gap, budget, overlap):
    out = []
    size = lambda ms: math.ceil(sum(u16(m[2]) for m in ms) / 4)
    for chat, ms in by_chat(rows).items():
        held = []
        for m in ms:
            if held and (m[3] - held[-1][3] > gap or size(held) + math.ceil(u16(m[2]) / 4) > budget):
                out.append((chat, [h[5] for h in held]))
                held = held[-overlap:]
            held.append(m)
        out.append((chat, [h[5] for h in held]))
    return sorted(out)


@pytest.mark.parametrize("mode", ["plain", "hot"])
@pytest.mark.parametrize("seed", [1, 2])
def test_budget_sessions_match_the_fold(spark, messages, request, mode, seed):
    if mode == "hot":
        request.getfixturevalue("hot")
    rows = random_chats(seed)
    got = S.session_rows(S.budget_segments(messages(rows), 7200, 40)).select("chat_id", "start_time", "end_time", "message_count")
    assert sorted(map(tuple, got.collect())) == fold_sessions(rows, 7200, 40)


@pytest.mark.parametrize("mode", ["plain", "hot"])
def test_chunks_match_the_fold(spark, messages, request, mode):
    if mode == "hot":
        request.getfixturevalue("hot")
    rows = random_chats(3)
    members = S.chunk_members(messages(rows), 600, 40, 5).groupBy("chat_id", "chunk_start").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line_number"))).alias("m")
    )
    got = sorted((r.chat_id, [x.line_number for x in r.m]) for r in members.collect())
    assert got == fold_chunks(rows, 600, 40, 5)


def test_children_reach_the_end(spark, messages):
    rows = [("c", "A", "x", 1_700_000_000 + i, "text", i) for i in range(19)]
    got = S.child_chunks(messages(rows)).orderBy("child_index").collect()
    assert [(r.start_time - 1_700_000_000, r.message_count) for r in got] == [(0, 8), (5, 8), (10, 8), (15, 4)]


def test_sliding_chunks_equal_slices(spark, messages):
    rows = [("c", "A", "x", 1_700_000_000 + i, "text", i) for i in range(14)]
    got = S.sliding_chunks(messages(rows)).orderBy("window_no").collect()
    assert [(r.start_time - 1_700_000_000, r.message_count) for r in got] == [(0, 8), (5, 8), (10, 4)]


def test_turns(spark, messages):
    rows = [("c", s, "x", 1_700_000_000 + i, "text", i) for i, s in enumerate("AABBA")]
    got = S.turn_rows(messages(rows)).orderBy("turn_no").collect()
    assert [(r.sender, r.message_count) for r in got] == [("A", 2), ("B", 2), ("A", 1)]


def test_oversized_message_is_its_own_session(spark, messages):
    rows = [("c", "A", "x" * n, 1_700_000_000 + i, "text", i) for i, n in enumerate([4, 400, 4, 4])]
    got = S.session_rows(S.budget_segments(messages(rows), 7200, 10)).orderBy("first_line").collect()
    assert [r.message_count for r in got] == [1, 1, 2]


def test_ordered_answers_are_the_same_for_hot_keys(hot, messages):
    rows = random_chats(7, chats=3, size=80)
    df = messages(rows)

    def answers(is_hot):
        o = Ordered.over(df, ["chat_id"], ["timestamp", "line_number"]).row_number("pos")
        o = o.previous({"p": "timestamp", "q": "sender"}).running_sum(F.length("content"), "run")
        assert (o.slice is not None) == is_hot
        return sorted(map(str, o.result().select("chat_id", "line_number", "pos", "p", "q", "run").collect()))

    sliced = answers(True)
    hot.conf.set("chatloom.hotGroupRows", "100000")
    assert sliced == answers(False)
