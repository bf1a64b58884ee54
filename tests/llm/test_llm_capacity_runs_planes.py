"""Bit-plane clusters, periodic runs and vector best fit against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from chatloom.llm import bestfit, periods, planes, queries, wordids

FOLDER = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


# --- bit planes ----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, cluster int, distance string"


def clusters_by_hand(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centres)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    whole = sum(d for _, _, d in last)
    return sorted(((i, n, d, sum(e for _, m, e in last if m == n), whole, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
                   for i, n, d in last), key=str)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=64) * (0.2 if i % 3 else 3) + i % 4).tolist()) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [rows[7], rows[7]]
    rows += [(300, None), (301, []), (302, [0.0] * 63), (303, [None] + [1.0] * 63), (304, [float("nan")] * 64),
             (305, [float("inf")] * 64), (306, [0.0] * 64), (307, [-0.0] * 64), (308, [1.0] * 64), (309, [-1e4] * 64)]
    return rows


@pytest.mark.parametrize("count", [192, 3, 1])
def test_clusters(spark, vectors, count):
    rows = vectors if count == 192 else vectors[:count]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)
    assert sorted(map(tuple, planes.cluster(table).collect()), key=str) == clusters_by_hand(rows)


def test_clusters_of_nothing_and_of_huge_numbers(spark, vectors):
    empty = spark.createDataFrame([], VECTORS)
    assert planes.cluster(empty).collect() == []
    rows = [*vectors[:20], (900, [1e300] * 64), (901, [131072.0] + [0.0] * 63)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    got = {r.vec_id: r for r in planes.cluster(table).collect()}
    assert sorted(got) == sorted(i for i, _ in rows)
    assert got[900].cluster is got[901].distance is got[901].centroid_sha256 is None and got[0].cluster is not None
    known = spark.createDataFrame([(None, vectors[0][1]), (1, vectors[1][1])], "vec_id long, embedding array<double>")
    assert planes.cluster(known).where("cluster is not null").count() == 2


def test_planes_hold_exact_products():
    r = np.random.default_rng(1)
    for width, top in ((64, 5), (64, planes.FIT), (200, 1000), (3, 1)):
        x = r.integers(-top, top, (30, width))
        c = r.integers(-top, top, (7, width))
        packed, other = planes.pack(x, planes.bits_of(x)), planes.pack(c, planes.bits_of(c))
        assert (planes.dots(packed, other) == x @ c.T).all()
        assert (planes.squares(packed) == (x * x).sum(axis=1)).all()
        assert (planes.totals(packed, width) == x.sum(axis=0)).all()
    assert planes.bits_of(np.array([-1])) == 1 and planes.bits_of(np.array([-1024, 1023])) == 11


# --- periodic runs -------------------------------------------------------------

def runs_by_hand(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            if len(part) >= max(6, 4 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((start, len(part), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def rows_by_hand(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len((text or "").encode().split())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def periodic(r):
    words = []
    while len(words) < r.randint(0, 150):
        part = [r.choice("abcdefgh"[: r.choice([1, 2, 2, 3, 8])]) for _ in range(r.randint(1, 12))]
        words += part * r.randint(1, 9)
        if r.random() < 0.4:
            del words[len(words) - r.randint(0, 6) :]
    return words


def test_runs_of_many_texts_at_once():
    r = random.Random(11)
    for _ in range(120):
        texts = [[w.encode() for w in periodic(r)] for _ in range(r.randint(0, 5))]
        assert periods.find(texts) == [runs_by_hand(t) for t in texts]


def test_runs_of_special_words():
    fibonacci, before = "a", "b"
    while len(fibonacci) < 400:
        fibonacci, before = fibonacci + before, fibonacci
    thue = [bin(i).count("1") % 2 for i in range(512)]
    for words in ([b"x"] * 1000, [c.encode() for c in fibonacci], [str(x).encode() for x in thue], [b"a", b"b"] * 300 + [b"b", b"a"] * 300):
        assert periods.find([words, words]) == [runs_by_hand(words)] * 2
    long = [str(i % 997).encode() for i in range(997 * 5 + 13)]
    assert periods.find([long]) == [[(0, len(long), 997)]]


def test_range_queries():
    r = np.random.default_rng(2)
    for n in (1, 2, 100, 1000):
        values = r.permutation(n)
        tree = periods.Wavelet(values)
        lo = r.integers(0, n, 50)
        hi = r.integers(lo + 1, n + 1)
        x = r.integers(0, n, 50)
        assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, x, strict=True)]
        k = r.integers(0, hi - lo)
        assert tree.nth(lo, hi, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, k, strict=True)]


def test_runs_of_a_table(spark, tmp_path):
    r = random.Random(5)
    texts = [None, "", " \n", "a", "é é é é é é x", "b " * 700, *(" ".join(periodic(r)) for _ in range(120))]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[20], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, strongest int").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((rows_by_hand(i, t) for i, t, *_ in rows), key=str)
    assert {f.name: f.dataType.simpleString() for f in got.schema} == {
        "doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint",
        "runs_sha256": "string", "collapsed_sha256": "string"}
    assert periods.table(docs.limit(0)).collect() == []


# --- vector best fit -----------------------------------------------------------

def test_word_ids_are_the_library_s():
    words = wordids.WordIds(public.path("word_bpe_49k.json"))
    r = random.Random(4)
    letters = "aabcdeeilmnorst ''.,-!0123éüñß  \t\n½µ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(500)]
    texts += ["a" * 777, "aaa aaaa aaaaa", "I'LL we'Ve 's", "", "  ", "x\x1cy", "Ωσς İ 你好", "<|endoftext|> a", "é x", "\x85a\x85b", "\x00 \x7f"]
    want = [np.array(words.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.ids(texts) == want and words.ids(texts) == want


@pytest.mark.parametrize("kind", ["norm", "dot"])
def test_every_capacity_binds(kind):
    r = np.random.default_rng(7)
    lengths = np.sort(r.integers(1, 60, 900))[::-1]
    for capacity in (bestfit.Capacity(100, 1000, 10**6), bestfit.Capacity(100, 4, 10**6), bestfit.Capacity(100, 1000, 3600)):
        got = bestfit.place(lengths, capacity, bestfit.Rule(kind))
        taken = np.array([np.bincount(got, w) for w in (lengths, np.ones(900), lengths**2)])
        assert (taken.T <= capacity.whole).all() and (taken[1] > 0).all()
        least = max(math.ceil(t.sum() / c) for t, c in zip(taken, capacity.whole, strict=True))
        assert least <= taken.shape[1] <= 1.15 * least
    assert bestfit.place(np.zeros(0, np.int64)).tolist() == []
    assert bestfit.Capacity(100, 9, 3600).longest == 60


def test_best_fit_table(spark):
    r = random.Random(6)
    say = lambda n: " ".join(r.choice(["alpha", "beta", "don't", "x9", "né"]) for _ in range(n))
    texts = [None, "", "one", say(2047), say(9000), *(say(r.randint(1, 900)) for _ in range(60))]
    rows = [(i, t, "s", 0) for i, t in enumerate(texts)] + [(1, "", "s", 0), (None, "null id", "s", 0), (None, "null id", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pool string, number int").repartition(3)
    path = public.path("word_bpe_49k.json")
    got = bestfit.pack(docs, path).collect()
    library = tokenizers.Tokenizer.from_file(path)
    want = []
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    held = {}
    for x in got:
        held.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    total = sum(n for parts in held.values() for _, n in parts)
    assert len(held) <= math.ceil(total / 2048) + 3
    assert bestfit.pack(docs.limit(0), path).collect() == []


def test_pools_do_not_mix(spark, monkeypatch):
    monkeypatch.setattr(bestfit, "POOL", 40)
    docs = spark.createDataFrame([(i, "word " * (i % 300)) for i in range(200)], "doc_id long, text string")
    got = bestfit.pack(docs, public.path("word_bpe_49k.json")).collect()
    assert len(got) == 200 and len({x.sequence_id >> 32 for x in got}) == 5


def test_whole_given_tables(spark):
    got = queries.QUERIES["op12_periodic_runs"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 4000").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in got.collect()}
    assert all(found[d.doc_id] == rows_by_hand(d.doc_id, d.text) for d in docs)
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    mine = queries.QUERIES["op11_bit_plane_clusters"](spark, FOLDER).collect()
    assert sorted(map(tuple, mine), key=str) == clusters_by_hand([tuple(r) for r in rows])
