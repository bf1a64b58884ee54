"""One behaviour at every size, full precision, and rows that used to go wrong."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom import session as S
from chatloom.functions import text as T
from chatloom.operators import extraction, people, reads, sessions, stats, vectors


def force(spark, hot):
    for key, value in ((S.SMALL_INPUT_BYTES, "0"), (S.HOT_GROUP_ROWS, "1")):
        spark.conf.set(key, value) if hot else spark.conf.unset(key)


@pytest.mark.parametrize("seed", range(4))
def test_sliced_keys_give_the_rows_of_whole_keys(spark, messages, seed):
    """Null keys, equal places, null times."""
    r = random.Random(seed)
    rows = [
        (r.choice((None, "a", "b")), "s", "w" * r.randint(1, 400), r.choice((None, 10, *range(0, 60_000, 900))), "text", r.randint(1, 3))
        for _ in range(120)
    ]
    # Rows of one place are alike, so that their order among themselves does not matter.
    rows = [(c, s, "x" * (7 * (zlib.crc32(repr((c, t, n)).encode()) % 40)), t, k, n) for c, s, _, t, k, n in rows]
    got = []
    for hot in (False, True):
        force(spark, hot)
        try:
            cut = sessions.budget_segments(messages(rows), budget=90)
            got.append((
                sorted(cut.groupBy("chat_id", "island", "cut_no").count().collect(), key=str),
                sorted(sessions.session_rows(cut).collect(), key=str),
            ))
        finally:
            force(spark, False)
    assert got[0] == got[1]


def test_null_chat_in_one_slice_per_row(spark, messages):
    rows = [(None, "s", "x" * 40, 5000 * i, "text", i) for i in range(40)]
    counts = []
    for hot in (False, True):
        force(spark, hot)
        try:
            counts.append(sessions.session_rows(sessions.gap_segments(messages(rows), gap=7000)).count())
        finally:
            force(spark, False)
    assert counts == [1, 1]


def test_nearest_of_nearly_equal_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0006]), (2, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert [x.vec_id for x in vectors.knn(asked, rows, 1).collect()] == [2]


def test_nearest_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 70)
    monkeypatch.setattr(vectors, "ROWS", 2)
    r = np.random.default_rng(2)
    x, q = r.normal(size=(300, 6)), r.normal(size=(8, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    got = {}
    for row in vectors.knn(asked, rows, 4).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = row.vec_id
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(1 - unit(q) @ unit(x).T, axis=1, kind="stable")[:, :4]
    assert got == {i: dict(enumerate(b.tolist(), 1)) for i, b in enumerate(best)}
    assert vectors.knn(asked.limit(0), rows, 4).count() == 0 == vectors.knn(asked, rows.limit(0), 4).count()


def test_nearest_of_odd_vectors_and_many_queries(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, None]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [1.0]), ("c", [0.0, 1.0, 0.0]), ("d", None), ("e", [0.0, 0.0])], "query_id string, embedding array<double>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.distance) for x in vectors.knn(asked, rows, 2).collect())
    assert got == [("a", 1, 1, 0.0), ("a", 2, 6, 0.0), ("c", 1, 5, 1.0), ("e", 1, 1, 1.0), ("e", 2, 2, 1.0)]
    r = np.random.default_rng(5)
    q, x = r.normal(size=(20_000, 4)), r.normal(size=(50, 4))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    best = np.argmax((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, axis=1)
    assert [v.vec_id for v in vectors.knn(asked, rows, 1).orderBy("query_id").collect()] == best.tolist()


def test_topic_threshold_is_exact(spark):
    rows = spark.createDataFrame([(1, [0.3499997, (1 - 0.3499997**2) ** 0.5])], "vec_id long, embedding array<double>")
    centers = spark.createDataFrame([(0, [1.0, 0.0])], "label int, embedding array<double>")
    assert vectors.nearest_centroid(rows, centers, 0.35).first().topic is None


def test_embedding_reads_the_whole_text(spark):
    rows = spark.createDataFrame([(1, "a" * 30), (2, "a" * 10 + "b" * 30), (3, " "), (4, None)], "id long, text string")
    model = lambda texts: [[t.count("a") / len(t), t.count("b") / len(t)] for t in texts]
    got = {x.id: x.embedding for x in vectors.embed(rows, "text", model, 2, piece=10).collect()}
    assert got[1] == [1.0, 0.0] and np.allclose(got[2], np.array([1, 3]) / 10**0.5) and got[3] == got[4] == [0.0, 0.0]


def test_equal_names_gain_once(spark, messages):
    known = spark.createDataFrame([("p2", "ANA", 1), ("p1", "Ana", 2)], "id string, name string, message_count long")
    spoken = messages([("c", "ana", "x", i, "text", i) for i in range(3)] + [("c", "Bo", "x", 9, "text", 9)])
    got = {(x.name, x.message_count, x.created) for x in people.merge_senders(known, spoken).collect()}
    assert got == {("ANA", 1, False), ("Ana", 5, False), ("Bo", 1, True)}


def test_first_session_of_a_person_in_all_parts(spark):
    rows = [("p", f"s{i:04d}", "c", "x") for i in range(450)]
    blocks = people.context_blocks(spark.createDataFrame(rows, "person_id string, session_id string, context string, summary string"))
    assert {(x.part, x.first_session) for x in blocks.collect()} == {(0, "s0000"), (1, "s0000"), (2, "s0000")}


def test_decomposed_and_far_letters(spark):
    texts = ["cafe\u0301s", "Ti\u1ebfng Vi\u1ec7t", "caf\u00e9s", "\u01ceb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.search_tokens(F.col("t")).alias("w")).collect()
    assert [x.w for x in got] == [["cafes"], ["tieng", "viet"], ["cafes"], ["ab"]]


def test_label_of_an_old_day(spark):
    label = T.relative_time(F.lit(1705536000), F.lit(1705536000 + 8 * 86400))
    assert spark.range(1).select(label).first()[0] == "18 de jan."


def test_relations_without_a_type(spark):
    rows = spark.createDataFrame([("a", "b", 0.5)], "source_id string, target_id string, strength double")
    assert reads.all_relations(rows).first().relation_type == "co_occurrence"


def test_synonyms_of_two_rows_add_up(spark):
    queries = spark.createDataFrame([("q", ["k"])], "query_id string, keywords array<string>")
    table = spark.createDataFrame([("k", ["it's"]), ("k", ["b", "it's"])], "keyword string, synonyms array<string>")
    assert sorted(extraction.expand_keywords(queries, table).first().keywords) == ["b", "it's", "k"]


def test_messages_of_one_place_do_not_multiply_samples(spark, messages):
    rows = messages([("c", "s", "word alpha", 1, "text", 1), ("c", "s", "word beta", 1, "text", 1), ("c", "s", "word alpha", 1, "text", 1)])
    terms = spark.createDataFrame([("c", "word")], "chat_id string, term string")
    assert sorted(x.sample for x in stats.sample_messages(rows, terms).collect()) == ["[s]: word alpha", "[s]: word beta"]
