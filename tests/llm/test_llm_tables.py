"""The operators on vectors, archives and the pipeline."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import forest, metric, queries, warc
from chatloom.llm.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, node string, score string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, equal vectors, one hot vector, and every kind of unusable one."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(400):
        centre = np.random.default_rng(i % 9).normal(size=12)
        v = centre + r.normal(size=12) * (0.05 if i % 3 else 0.6)
        rows.append((i, v.tolist(), i % 4, "n", "s"))
    hot = r.normal(size=12).tolist()
    rows += [(1000 + i, hot, 1, None, None) for i in range(120)]
    rows += [(2000, None, 1, None, None), (2001, [0.0] * 12, 1, None, None), (2002, [None] + [1.0] * 11, 1, None, None),
             (2003, [float("nan")] * 12, 1, None, None), (2004, [float("inf")] * 12, 1, None, None),
             (2005, hot, None, None, None), (2050, [2 * x for x in hot], 2, None, None), (2006, [], 1, None, None)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def usable(rows):
    return [r for r in rows if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]


def test_forest(vectors):
    rows = usable(vectors.collect())
    x = np.array([r.embedding for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in forest.search(vectors, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [i for i, v in enumerate(ids) if v % 50 == 0]
    assert sorted(got) == sorted(ids[asked].tolist())
    for i in asked:
        c = u @ u[i]
        c[i] = -9
        own = sorted(got[ids[i]])
        assert [p for p, _, _ in own] == [1, 2, 3, 4, 5]
        best = np.lexsort((ids, -np.round(c, 12)))[:5]
        assert [v for _, v, _ in own] == ids[best].tolist()
        assert np.allclose([s for _, _, s in own], c[best], atol=1e-12)


def test_forest_opens_few_leaves_and_blocks(vectors, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 7)
    found = forest.search(vectors, F.col("vec_id") % 50 == 0, candidates=600)
    assert found.groupBy("query_id").count().where("count <> 5").count() == 0
    few = vectors.where("vec_id in (0, 1, 2)")
    assert forest.search(few, F.col("vec_id") == 0).count() == 2
    assert forest.search(vectors.limit(0), F.lit(True)).count() == 0


def test_forest_of_several_lengths(spark):
    rows = [(i, [1.0, i / 7]) for i in range(8)] + [(100 + i, [1.0, 0.0, i / 5]) for i in range(6)] + [(200, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in forest.search(table, F.col("vec_id") % 50 == 0, k=2).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
    assert {q: sorted(v) for q, v in got.items()} == {0: [(1, 1), (2, 2)], 100: [(1, 101), (2, 102)]}


def test_forest_with_a_budget_far_below_the_table(spark, monkeypatch):
    """Trees of a small sample are split on over all rows, and no crowded leaf ends the search."""
    monkeypatch.setattr(forest, "LEAF_ROWS", 60, raising=False)
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 12))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in forest.search(table, F.col("vec_id") % 50 == 0, candidates=300, sample=100).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 3000, 50):
        c = u @ u[i]
        c[i] = -9
        hits += len(got[i] & set(np.argsort(-c)[:5].tolist()))
    assert hits / 300 > 0.9, hits / 300
    crowded = forest.grow(u[:200], leaf=20)
    held = np.full(crowded.leaves + 1, 10**6)
    opened = crowded.open(crowded.normal @ u[0] - crowded.offset, held, 300, 4)
    assert len(opened) == len(set(opened)) == 4 * forest.TREES


@pytest.mark.parametrize(("cell", "block"), [(2000, 4096), (20, 4096), (20, 16)])
def test_metric_join(vectors, monkeypatch, cell, block):
    monkeypatch.setattr(metric, "CELL", cell)
    monkeypatch.setattr(metric, "BLOCK", block)
    rows = vectors.collect()
    good = [r for r in usable(rows) if r.label is not None]
    x = np.array([r.embedding for r in good])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label, ids = np.array([r.label for r in good]), np.array([r.vec_id for r in good])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    low = ids.copy()
    for _ in range(len(ids)):
        new = np.array([low[n].min() for n in near])
        if (new == low).all():
            break
        low = new
    want = {r.vec_id: (0, r.vec_id, True) for r in rows}
    want |= {int(i): (int(n.sum()) - 1, int(c), bool(c == i)) for i, n, c in zip(ids, near, low, strict=True)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric.links(vectors).collect()}
    assert got == want
    assert metric.links(vectors.limit(0)).count() == 0


def test_metric_join_with_many_labels_and_lengths(spark, monkeypatch):
    """Far more labels above the size of a cell than get pivots; two lengths under a label."""
    monkeypatch.setattr(metric, "CELL", 5)
    monkeypatch.setattr(metric, "PIVOTS", 8)
    arc = lambda n, label, base: [(base + i, [float(np.cos(i / 9)), float(np.sin(i / 9))], label) for i in range(n)]
    rows = [x for n in range(4) for x in arc(28, n, 100 * n)]
    rows += [x for n in range(4, 60) for x in arc(6, n, 100 * n)]
    rows += [(9000 + i, [1.0, 2.0, 3.0], 1) for i in range(3)] + [(9003, [3.0, 2.0, 1.0], 1)]
    want = {}
    for n in range(60):
        last = 27 if n < 4 else 5
        want |= {100 * n + i: (min(i, 1) + min(last - i, 1), 100 * n) for i in range(last + 1)}
    want |= {9000 + i: (2, 9000) for i in range(3)} | {9003: (0, 9003)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in metric.links(table).collect()} == want


def test_revisits(spark):
    header = lambda **h: [(k.replace("_", "-"), v) for k, v in h.items()]
    rows = [
        (1, "http://A.example:80/p/", 10, 200, header(ETag='"v1"', Date="d1", Content_Type="html"), "x"),
        (2, "https://a.example/p#top", 20, 304, header(etag='W/"v1"', date="d2", content_type="zip"), "x"),
        (3, "https://a.example/p?utm_source=x", 30, 304, header(etag='"v2"'), "x"),
        (4, "http://a.example/p", 5, 304, header(etag='"v1"'), "x"),
        (5, "http://a.example/p", 40, 304, None, "x"),
        (6, "http://a.example/p", 50, 304, header(last_modified="m"), "x"),
        (7, None, 60, 304, header(etag='"v1"'), "x"),
        (8, "http://a.example/p", None, 304, header(etag='"v1"'), "x"),
        (9, "http://a.example/p", 10, 304, header(etag='"v1"', vary="*"), "x"),
    ]
    rows += [(100 + i, "http://hot.example/", 100 + i, 200 if i % 7 == 0 else 304, header(etag=f'"{i // 7}"'), "x") for i in range(200)]
    schema = "record_id long, url string, fetched long, status int, headers array<struct<name:string,value:string>>, slice string"
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame([*rows, rows[0]], schema)).collect()}
    verdict = {k: (r.refers_to, r.verdict) for k, r in got.items() if k < 100}
    assert verdict == {2: (1, "resolved"), 3: (1, "changed"), 4: (None, "no response"), 5: (1, "unverified"), 6: (1, "changed"),
                       7: (None, "no response"), 8: (None, "no response"), 9: (1, "resolved")}
    assert got[2].headers == 'content-type: html\ndate: d2\netag: W/"v1"'
    assert all(got[100 + i].refers_to == 100 + i - i % 7 and got[100 + i].verdict == "resolved" for i in range(200) if i % 7)
    assert warc.resolve(spark.createDataFrame([], schema)).count() == 0


def test_revisits_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    cursor = db.execute(ORACLES["op3_revisit_resolution"])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES["op3_revisit_resolution"](spark, FOLDER).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cursor.fetchall(), key=str)


# --- the whole tables ----------------------------------------------------------

def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", ["op1_quality_fm", "op7_language_id"])
def test_learned_on_the_given_table(spark, name):
    folder = FOLDER.replace("0.001", "0.01")
    got = queries.QUERIES[name](spark, folder)
    rows = got.where("held_out")
    if name.startswith("op1"):
        both = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
        assert both.where("quality = predicted").count() > 0.9 * both.count()
    else:
        both = rows.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
        assert both.where("lang = lang_pred").count() > 0.97 * both.count()
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_pipeline(spark, tmp_path):
    """Every stage on what the one before kept, against brute force."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_llm_texts import cut, linked

    from chatloom.llm import secrets

    r = random.Random(21)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = say(120)
    texts = [say(60) for _ in range(20)] + [say(40) + " " + passage + " " + say(40) for _ in range(4)]
    texts += [texts[3], texts[4] + " more", None, "", "12 34", say(10) + ' password = "hunter2hunter2" ' + say(10)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    os.makedirs(tmp_path / "sf")
    given.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], str(tmp_path / "sf")).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    pairs = [[(x.doc_id, x.text) for x in k.select("doc_id", "text").orderBy("doc_id").collect()] for k in kept[:5]]
    assert [d for d, _ in pairs[1]] == [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    assert [d for d, _ in pairs[2]] == sorted(d for d, _, c in linked(pairs[1]) if d == c)
    sizes = {d: (n - gone) for d, n, gone, _, _ in cut(pairs[2], corpus_pipeline.PASSAGE)}
    assert {d: len(t.encode()) for d, t in pairs[3]} == sizes and sum(sizes.values()) < sum(len(t) for _, t in pairs[2])
    assert all(t == secrets.redact(b, secrets.scan(b)[1]) for (_, t), (_, b) in zip(pairs[4], pairs[3], strict=True))
    assert "[SECRET]" in dict(pairs[4])[len(texts) - 1]
    assert {x.doc_id for x in kept[5].collect()} == {d for d, _ in pairs[4]}
    assert kept[1].columns == kept[2].columns == kept[3].columns == kept[4].columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() == kept[5].count()


def test_pipeline_keeps_one_of_repeated_rows(spark):
    """Repeated rows, one id with near copies, one id with unlike texts, null ids: one row
    of each group stays, and the suffix stage leaves it whole."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(4, 9))) for _ in range(900)]
    a, b, c, d, e = (" ".join(r.choice(words) for _ in range(120)) for _ in range(5))
    given = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "en", "r", 1), (7, a, "en", "s", 1),
             (2, b, "en", "s", 1), (2, b + " more", "en", "s", 1), (2, c, "en", "s", 1),
             (None, d, "en", "s", 1), (None, d, "en", "s", 1), (None, d + " more", "en", "s", 1), (None, e, "en", "s", 1), (9, e, "en", "s", 1),
             (3, None, "en", "s", 1), (3, None, "en", "s", 1)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    rows = sorted(((x.doc_id, x.text, x.source) for x in kept.collect()), key=str)
    assert [x for x in rows if x[0] in (1, 3, 7, 9)] == sorted([(1, a, "r"), (3, None, "s"), (3, None, "s"), (9, e, "s")], key=str)
    of = lambda i: [t for k, t, _ in rows if k == i]
    assert len(of(2)) == 2 and c in of(2) and len(of(None)) == 1 and of(None)[0] in (d, d + " more")
    after = sorted(((x.doc_id, x.text or "") for x in corpus_pipeline.repeats(spark, kept, "").collect()), key=str)
    assert after == sorted(((k, t or "") for k, t, _ in rows), key=str)
