import json
import random

import numpy as np
from pyspark.sql import functions as F

from chatloom.functions import constants as K
from chatloom.operators import analytics, extraction as E, people as P, ranges, vectors
from chatloom.session import durable


def test_recover_json(spark):
    body = '{"summary":"s","mentioned_entities":[]}'
    cases = [(body, body), (f"```json\n{body}\n```", body), (f"Sure: {body} ok", body), ("hello", None), ("x [1, 2] y", "[1, 2]"), ("{oops} [1]", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r.j for r in df.select("i", E.recover_json(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_failed_rows_are_asked_again(spark):
    def model(prompts):
        return ['{"summary": "ok"}' if "not valid JSON" in p or "good" in p else "nope" for p in prompts]

    rows = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    got = {r.prompt: (r.attempts, r.status) for r in E.ask(rows, "prompt", model, 2).collect()}
    assert got == {"good": (1, "ok"), "bad": (2, "ok")}
    got = {r.prompt: (r.attempts, r.status) for r in E.ask(rows, "prompt", model, 1).collect()}
    assert got["bad"] == (1, "failed")


def test_batches_are_padded_and_cut(spark):
    two = json.dumps({"results": [{"summary": "a", "mentioned_entities": []}, {"summary": ""}]})
    rows = spark.createDataFrame([(["s1", "s2", "s3"], two, "ok"), (["s4"], two, "ok"), (["s5"], "x", "failed")], "sessions array<string>, answer string, status string")
    got = {r.session_id: r.summary for r in E.unpack_sessions(rows).collect()}
    assert got == {"s1": "a", "s2": K.EXTRACTED_SUMMARY, "s3": K.PADDED_SUMMARY, "s4": "a", "s5": K.FAILED_SUMMARY}


RULES = E.QueryRules(
    counting=("quantas vezes", "mais citad"), telling=("o que rolou", "falaram sobre"), recent=("recente",),
    filler=tuple("quais mais citados na conversa o que falaram sobre rolou qual a senha do foi".split()),
)


def test_classification_examples(spark):
    texts = ["quais jogos mais citados na conversa", "o que falaram sobre o projeto delta ontem?", "o que rolou na semana passada?",
             "qual a SENHA do wifi", "O que rolou de mais recente", "o que rolou", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")
    got = [(r.intent, r.keywords) for r in E.classify_queries(df, RULES).orderBy("query_id").collect()]
    assert got == [("aggregation", ["jogos"]), ("narrative", ["projeto", "delta"]), ("narrative", ["#RECENT#"]), ("factual", ["wifi"]),
                   ("narrative", ["de", "recente"]), ("narrative", []), ("factual", [])]
    none = [(r.intent, r.keywords) for r in E.classify_queries(df.limit(1), E.QueryRules()).collect()]
    assert none == [("factual", ["quais", "jogos", "mais", "citados", "na", "conversa"])]


def test_expand_keywords(spark):
    df = spark.createDataFrame([("q", ["jogos", "x"]), ("r", ["x"])], "query_id string, keywords array<string>")
    known = spark.createDataFrame([("jogos", ["game", "x", "play"]), ("other", ["y"])], "keyword string, synonyms array<string>")
    got = {r.query_id: r.keywords for r in E.expand_keywords(df, known).collect()}
    assert got == {"q": ["jogos", "x", "game", "play"], "r": ["x"]}


def test_entity_defaults(spark):
    rows = spark.createDataFrame([("s", [(" Ana ", None, None, None, None), ("", "person", None, None, None)])], f"session_id string, mentioned_entities array<{E.ENTITY}>")
    got = P.entity_rows(rows).collect()
    assert [(r.normalized_name, r.type, r.action) for r in got] == [("ana", "unknown", "mentioned")]


def test_context_parts_hold_every_line(spark, request):
    rows = spark.createDataFrame([(f"s{i:03d}", "p", f"c{i}", "sum" if i % 2 else None) for i in range(25)], "session_id string, person_id string, context string, summary string")
    want = P.context_blocks(rows, 10).orderBy("part").collect()
    assert [r.mentions for r in want] == [10, 10, 5]
    request.getfixturevalue("hot")
    hot = P.context_blocks(rows, 10).orderBy("part").collect()
    assert want == hot
    assert sum(r.context.count("Contexto") for r in want) == 25


def test_resolution(spark):
    pending = spark.createDataFrame([("1", "s1", "Bia", "x", 1), ("2", "s2", " bia ", "y", 2), ("3", "s3", "Leo", "z", 3), ("4", "s4", "Zé", "w", 4)], "id string, session_id string, alias string, context string, timestamp long")
    decisions = spark.createDataFrame([("1", "create_new", None), ("3", "link_existing", "p9"), ("4", "link_existing", None), ("7", "ignore", None)], "mention_id string, action string, person_id string")
    out = P.resolve_mentions(pending, decisions)
    assert [r.name for r in out["people"].collect()] == ["Bia"]
    assert sorted(r.session_id for r in out["mentions"].collect()) == ["s1", "s2", "s3"]
    assert [r.id for r in out["pending"].collect()] == ["4"]
    assert sorted((r.mention_id, r.reason) for r in out["errors"].collect()) == [("4", "person_id_required"), ("7", "mention_not_found")]


def test_range_join_matches_brute_force(spark, messages):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), "A", "x", rng.randint(0, 400_000_000), "text", i) for i in range(120)]
    spans = []
    for i in range(60):
        start = rng.randint(0, 400_000_000)
        spans.append((f"s{i}", rng.choice("ab"), start, start + rng.choice([0, 3600, 90_000, 9_000_000, 300_000_000])))
    sessions = spark.createDataFrame(spans, "id string, chat_id string, start_time long, end_time long")
    got = sorted((r.session_id, r.line_number) for r in ranges.messages_in_sessions(messages(rows), sessions).collect())
    assert got == sorted((s[0], m[5]) for s in spans for m in rows if s[1] == m[0] and s[2] <= m[3] <= s[3])


def test_name_variants_match_brute_force(spark):
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted((r.name_a, r.name_b, r.distance) for r in analytics.name_variants(df).collect())
    assert got == [(a, b, distance(a, b)) for a in names for b in names if a < b and distance(a, b) <= 2]


def test_knn_and_embed(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(50, 8))
    data[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", data[i].tolist()) for i in range(3)], "query_id string, embedding array<double>")
    got = {}
    for r in vectors.knn(asked, rows, 4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    sizes = np.linalg.norm(data, axis=1)
    for i in range(3):
        cos = np.array([data[i] @ v / (sizes[i] * s) if s else 0 for v, s in zip(data, sizes)])
        assert got[f"q{i}"] == np.lexsort((np.arange(50), np.round(1 - cos, 6)))[:4].tolist()
    texts = spark.createDataFrame([(1, "abc"), (2, "  "), (3, None)], "i int, t string")
    got = {r.i: r.embedding for r in vectors.embed(texts, "t", lambda ts: [[3.0, 4.0]] * len(ts), 2).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_durable_uses_the_named_folder(spark, tmp_path):
    # Only a session without a folder gets one of its own.
    df = durable(spark.range(3))
    assert spark.sparkContext.getCheckpointDir() is not None
    assert df.count() == 3


def test_import_from_files_to_inbox(spark, tmp_path, messages):
    """Files to chats, sessions with summaries, entities, links and inbox; a second import of the same adds nothing."""
    from chatloom.operators import imports
    from chatloom.sources import exports

    rows = [("c1", s, f"oi {i}", 1714573800 + 60 * i, "text", i) for i, s in enumerate(["Ana", "Bia"] * 4)]
    rows += [("c1", "Ana", f"tarde {i}", 1714673800 + 60 * i, "text", 20 + i) for i in range(4)]
    rows += [("c2", "Caio", "x", 1714573800, "text", 0)]
    exports.write_exports(messages(rows), str(tmp_path))

    def model(prompts):
        names = [{"name": "bia", "type": "person"}, {"name": "Zoe", "type": "person", "context": "x"}, {"name": "Ana", "type": "person", "is_participant": True}, {"name": ""}]
        return [json.dumps({"summary": f"resumo {p.count('oi')}", "mentioned_entities": names}) for p in prompts]

    known = spark.createDataFrame([("p0", "BIA", 5)], "id string, name string, message_count long")
    parsed = exports.read_exports(spark, str(tmp_path))
    got = imports.import_chats(parsed, known, model)
    assert sorted((r.id, r.message_count) for r in got["chats"].collect()) == [("c1", 12), ("c2", 1)]
    assert sorted(r.summary for r in got["sessions"].collect()) == ["Sessão breve com 1 mensagens.", "resumo 0", "resumo 8"]
    assert sorted((r.name, r.message_count) for r in got["people"].collect()) == [("Ana", 8), ("BIA", 9), ("Caio", 1)]
    assert {(r.person_id, r.processed) for r in got["mentions"].collect()} == {("p0", False)} and got["mentions"].count() == 2
    assert [r.alias for r in got["pending"].collect()] == ["Zoe"] * 2 and got["entities"].count() == 6
    again = imports.import_chats(parsed, got["people"], model, stored=got["messages"])
    assert all(again[name].count() == 0 for name in ("messages", "chats", "sessions", "entities", "mentions", "pending"))
