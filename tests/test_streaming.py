import os

from chatloom.operators import sessions as S
from chatloom.streaming import jobs
from chatloom.streaming.catalog import drained, with_end

ROWS = [("c1", i * 60 * (1 + i % 3), "x" * (i % 30)) for i in range(200)]
SCHEMA = "chat_id string, sender string, content string, timestamp long, type string, line_number long"


def stored(spark, folder, parts=3):
    rows = [(c, "A", s, 1_700_000_000 + t, "text", i) for i, (c, t, s) in enumerate(sorted(ROWS, key=lambda r: r[1]))]
    rows.append(("c2", "A", "late", rows[-1][3] + 10_000_000, "text", 0))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    return spark.read.parquet(folder), spark.readStream.schema(SCHEMA).parquet(folder)


def test_budget_stream_equals_batch(spark, tmp_path):
    batch, stream = stored(spark, str(tmp_path / "in"))
    got = drained(jobs.budget_sessions(stream, 600, 30), str(tmp_path / "run")).collect()
    want = S.session_rows(S.budget_segments(batch, 600, 30)).select("chat_id", "start_time", "end_time", "message_count").collect()
    closed = [r for r in want if r.chat_id == "c1"]
    assert sorted(map(tuple, got)) == sorted(map(tuple, closed))


def test_gap_stream_equals_batch(spark, tmp_path):
    batch, stream = stored(spark, str(tmp_path / "in"))
    got = drained(jobs.gap_sessions(stream, 120), str(tmp_path / "run")).collect()
    want = S.session_rows(S.gap_segments(batch, 120)).select("chat_id", "start_time", "end_time", "message_count").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in want if r.chat_id == "c1")


def test_import_stream_skips_known_files_and_messages(spark, tmp_path):
    incoming, tables, state = tmp_path / "in", str(tmp_path / "tables"), str(tmp_path / "state")
    incoming.mkdir()
    one = "01/05/2024 14:30 - A: um\n01/05/2024 14:30 - A: um\n01/05/2024 14:31 - B: dois\n"
    (incoming / "Chat 1.txt").write_text(one)
    (incoming / "copy.txt").write_text(one)
    jobs.import_stream(spark, str(incoming), tables, state).awaitTermination()
    chats = spark.read.parquet(f"{tables}/chats").collect()
    assert [(c.name, c.message_count) for c in chats] == [("Chat 1", 3)]
    assert spark.read.parquet(f"{tables}/messages").count() == 2
    (incoming / "again.txt").write_text(one)
    (incoming / "new.txt").write_text("01/05/2024 14:30 - C: x\n")
    jobs.import_stream(spark, str(incoming), tables, state).awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(f"{tables}/chats").collect()) == ["Chat 1", "new"]
    assert spark.read.parquet(f"{tables}/messages").count() == 3


def test_import_stream_equals_batch_over_shuffled_files(spark, tmp_path):
    """Files arrive in several batches, some again under other names, one with odd letters in its name."""
    import random

    from chatloom.operators import parsing, store
    from chatloom.sources import exports

    r = random.Random(3)
    texts = ["".join(f"01/05/2024 14:{i % 60:02d} - P{r.randint(0, 3)}: m{r.randint(0, 9)}\nmais\n" for i in range(r.randint(1, 40))) for _ in range(12)]
    arrivals = [(f"f{i}.txt", t) for i, t in enumerate(texts)] + [(f"again {i} [x]+%.txt", texts[i]) for i in range(0, 12, 2)]
    r.shuffle(arrivals)
    incoming, tables, state = tmp_path / "in", str(tmp_path / "tables"), str(tmp_path / "state")
    incoming.mkdir()
    for a in range(0, len(arrivals), 5):
        for name, text in arrivals[a : a + 5]:
            (incoming / name).write_text(text)
        jobs.import_stream(spark, str(incoming), tables, state, files_per_batch=2).awaitTermination()
    whole = parsing.parse_lines(exports.split_lines(spark.createDataFrame(list(enumerate(texts)), "file int, text string"), "file", "text"))
    want = store.insert_messages(None, whole).select("sender", "content", "timestamp", "line_number")
    got = spark.read.parquet(f"{tables}/messages")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(f"{tables}/chats").count() == len(set(texts)) == got.select("chat_id").distinct().count()


def test_tags_are_taken_once_over_batches(spark, tmp_path):
    def model(prompts):
        return ['{"tags": ["pai", "gamer"], "memories": []}' for _ in prompts]

    sessions = spark.createDataFrame([("s1", "resumo")], "id string, summary string")
    schema = "session_id string, person_id string, context string, processed boolean"
    folder, tables = str(tmp_path / "in"), str(tmp_path / "t")
    for i, person in enumerate(["p1", "p2", "p1"]):
        spark.createDataFrame([(f"s{i}", person, "c", False)], schema).coalesce(1).write.mode("append").json(folder)
        arriving = spark.readStream.schema(schema).json(folder)
        jobs.knowledge_stream(arriving, sessions, model, tables, str(tmp_path / "k")).awaitTermination()
        jobs.tag_stream(spark, tables, str(tmp_path / "g")).awaitTermination()
    rows = spark.read.parquet(f"{tables}/person_tags").collect()
    assert sorted((r.person_id, r.tag, r.batch) for r in rows) == [("p1", "gamer", 0), ("p1", "pai", 0), ("p2", "gamer", 1), ("p2", "pai", 1)]
    assert spark.read.parquet(f"{tables}/offered_tags").count() == 6


def test_knowledge_pass_marks_everything(spark):
    mentions = spark.createDataFrame([("s1", "p1", "c", False), ("s2", "p1", None, False), ("s3", "p2", None, False), ("s4", "p1", "old", True)], "session_id string, person_id string, context string, processed boolean")
    sessions = spark.createDataFrame([("s1", "resumo")], "id string, summary string")
    tags = spark.createDataFrame([("p1", "pai")], "person_id string, tag string")

    def model(prompts):
        return ['{"tags": ["pai", "gamer"], "memories": [" Viajou ", " "]}' for _ in prompts]

    out = jobs.knowledge_pass(mentions, sessions, tags, model)
    assert [r.tag for r in out["tags"].collect()] == ["gamer"]
    assert [(r.memory, r.session_id) for r in out["memories"].collect()] == [("Viajou", "s1")]
    assert all(r.processed for r in out["mentions"].collect())
    assert tuple(out["metrics"].first()) == (1, 2, 1, 1, 0, None, 0)
    broken = jobs.knowledge_pass(mentions, sessions, tags, lambda prompts: ["no"] * len(prompts), now=7)["metrics"].first()
    assert (broken.people_processed, broken.people_failed, broken.last_run) == (0, 1, 7) and "Expecting value" in broken.last_error


def test_budget_stream_equals_batch_whatever_the_files(spark, tmp_path):
    """Rows arrive in shuffled order inside the watermark, over several files; the tail is told."""
    import random

    r = random.Random(5)
    base = 1_700_000_000
    rows = [(r.choice("ab"), "A", "x" * r.randint(1, 60), base + 240 * i + r.randint(0, 90), "text", i) for i in range(60)]
    rows += [("c", "A", "x" * 8, base + t, "text", 900 + n) for n, t in enumerate((0, 1000, 600, 1500))]
    rows.sort(key=lambda x: x[3] + r.randint(0, 1500))
    whole = spark.createDataFrame(rows, SCHEMA)
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    os.makedirs(source)
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for a in range(0, len(rows), 13):
        spark.createDataFrame(rows[a : a + 13], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = drained(jobs.budget_sessions(with_end(arriving, folder), 700, 30), folder)
    got = drained(jobs.budget_sessions(with_end(arriving, folder), 700, 30), folder, arriving)
    want = S.session_rows(S.budget_segments(whole, 700, 30)).select("chat_id", "start_time", "end_time", "message_count")
    assert out.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
