"""Large contexts, periods, name variants by segments, change logs, timelines, hashed embeddings."""

import random
from itertools import combinations

import pytest

from chatloom.operators import analytics, stats, store


def test_large_contexts_are_a_grid(spark, monkeypatch):
    """A context far above a block gives the same pairs, and no group of its size."""
    r = random.Random(3)
    rows = [("big", p) for p in range(130)] + [(f"c{i}", r.randrange(40)) for i in range(30) for _ in range(r.randint(1, 6))] + [(None, 1), ("big", None)]
    table = spark.createDataFrame(rows, "context_id string, person_id int")
    want = {(x.source_id, x.target_id): (x.shared, x.strength) for x in analytics.relations(table).collect()}
    met = {}
    for c in {c for c, _ in rows if c}:
        for a, b in combinations(sorted({p for k, p in rows if k == c and p is not None}), 2):
            met[a, b] = met.get((a, b), 0) + 1
    assert {k: n for k, (n, _) in want.items()} == met
    monkeypatch.setattr(analytics, "CONTEXT_BLOCK", 7)
    assert {(x.source_id, x.target_id): (x.shared, x.strength) for x in analytics.relations(table).collect()} == want
    plan = analytics.shared_contexts(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "i#" in plan and "j#" in plan


def test_periods_are_differences(spark):
    r = random.Random(4)
    rows = [(f"c{i}", r.randrange(8), i % 12) for i in range(150) for _ in range(3)]
    running = analytics.running_relations(spark.createDataFrame(rows, "context_id string, person_id int, bucket int"))
    for first, last in ((0, 11), (3, 3), (4, 9), (11, 20), (30, 40)):
        want = {}
        for c in {c for c, _, b in rows if first <= b <= last}:
            for pair in combinations(sorted({p for k, p, _ in rows if k == c}), 2):
                want[pair] = want.get(pair, 0) + 1
        got = {(x.source_id, x.target_id): x.shared for x in analytics.relations_in_period(running, first, last).collect()}
        assert got == want
    few = spark.createDataFrame([(1,), (2,), (2,)], "person_id int")
    assert {(x.source_id, x.target_id) for x in analytics.relations_in_period(running, 0, 11, few).collect()} <= {(1, 2)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("hot", [200, 3, 0])
def test_name_variants_are_brute_force(spark, monkeypatch, hot):
    """Random short and long names, and many with one prefix, whatever counts as hot."""
    monkeypatch.setattr(analytics, "HOT_SEGMENT", hot)
    r = random.Random(8)
    names = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(90)]
    names += [f"customer number {i:04d}" for i in range(0, 400, 9)]
    for n in names[:40]:
        n = list(n)
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(n) + 1)
            n[at : at + r.randint(0, 1)] = [r.choice("abcx")] * r.randint(0, 1)
        names.append("".join(n))
    table = spark.createDataFrame([(n,) for n in [*names, None, "", " ", "ÀB", "ab"]], "name string")
    kept = sorted({n for n in names if n} | {"ab"})
    want = {(a, b): distance(a, b) for a, b in combinations(kept, 2) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    got = {(x.name_a, x.name_b): x.distance for x in analytics.name_variants(table).collect()}
    assert got == want


def test_replay_of_a_log(spark):
    r = random.Random(9)
    log = [(r.choice(["put", "put", "delete", "clear"] if r.random() < 0.3 else ["put", "delete"]), r.choice(["x", "y", None]), r.choice([1, 2, 3, None]), i // 2, f"v{i}")
           for i in range(200)]
    alive = {}
    order = {"clear": 0, "delete": 1, "put": 2}
    # Of changes at one time, kinds have an order and the later value of a kind is not defined: keep one per time, key and kind.
    seen, unique = set(), []
    for op, scope, key, at, text in log:
        if (op, scope, key, at) not in seen:
            seen.add((op, scope, key, at))
            unique.append((op, scope, key, at, text))
    for op, scope, key, at, text in sorted(unique, key=lambda x: (x[3], order[x[0]])):
        if op == "clear":
            alive = {k: v for k, v in alive.items() if k[0] != scope}
        elif op == "delete":
            alive.pop((scope, key), None)
        else:
            alive[scope, key] = (at, text)
    changes = spark.createDataFrame(unique, "op string, scope string, id int, at int, text string").repartition(3)
    got = store.replay(changes, ["id"], ["at"], ["scope"])
    assert got.columns == ["scope", "id", "at", "text"]
    assert {(x.scope, x.id): (x["at"], x.text) for x in got.collect()} == alive
    assert store.replay(changes.limit(0), ["id"], ["at"], ["scope"]).count() == 0


def test_timeline_merges_days(spark):
    now = 1710430200  # 2024-03-14
    rows = [("a", "ontem", now), ("a", "hoje", now), ("a", "ontem", now), ("a", "em janeiro", now), ("a", "10/01/2024", now), ("a", "sem data", now),
            ("b", "ontem e 2024-03-20", now), (None, "ontem", now), ("c", None, now)]
    table = spark.createDataFrame(rows, "event string, text string, at long")
    got = analytics.event_timeline(table, "event", "text", "at").collect()
    assert sorted((x.event, str(x.first_day), str(x.last_day), x.mentions) for x in got) == [
        ("a", "2024-01-01", "2024-01-31", 2), ("a", "2024-03-13", "2024-03-14", 3), ("b", "2024-03-13", "2024-03-13", 1), ("b", "2024-03-20", "2024-03-20", 1)]


def test_topics_of_sessions(spark):
    rows = spark.createDataFrame([("s1", "Pedir pizza e lanche no delivery, vamos comer"), ("s2", "zzz qqq"), ("s3", ""), ("s4", None)], "session_id string, transcript string")
    got = {x.session_id: x for x in stats.session_topics(rows, 0.4).collect()}
    assert got["s1"].topic == "food" and got["s1"].label == "comida e refeições"
    assert got["s3"].topic is got["s4"].topic is got["s2"].topic is None and len(got) == 4
    assert stats.topic_probes(spark).count() == 20
