import hashlib
import json
import zipfile

import pytest

from chatloom.operators import parsing as P
from chatloom.operators import store
from chatloom.sources import exports as X


def test_line_numbers_across_blocks(spark, tmp_path):
    text = "".join(f"linha {i} {'x' * (i % 7)}\r\n" for i in range(1, 400)) + "fim"
    (tmp_path / "Chat um.txt").write_bytes(text.encode())
    (tmp_path / "b.txt").write_bytes("﻿a\rb\nc\n".encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = X.read_lines(spark, str(tmp_path), whole_file_bytes=1000)
        assert lines.select("block").distinct().count() > 3
        rows = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    long = sorted((r.line_number, r.line) for r in rows if "Chat" in r.file)
    assert [n for n, _ in long] == list(range(1, 401))
    assert [s for _, s in long] == text.split("\r\n")
    assert sorted((r.line_number, r.line) for r in rows if "b.txt" in r.file) == [(1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("whole", [1000, 1 << 30])
def test_messages_across_blocks(spark, tmp_path, whole):
    text = "".join(f"01/05/2024 14:{i % 60:02d} - A{i % 3}: m{i}\nmais {i}\n" for i in range(200))
    (tmp_path / "c.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        rows = P.parse_lines(X.read_lines(spark, str(tmp_path), whole)).orderBy("line_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.content for r in rows] == [f"m{i}\nmais {i}" for i in range(200)]


def test_write_and_read_back(spark, tmp_path, messages):
    rows = [("c1", "A", "um\ndois", 1714573800, "text", 1), ("c1", "B", "três", 1714573860, "text", 2), ("c2", "A", "x", 1714573800, "text", 1)]
    X.write_exports(messages(rows), str(tmp_path / "out"))
    back = P.parse_lines(X.read_lines(spark, str(tmp_path / "out/*/*.txt"))).collect()
    assert sorted((r.sender, r.content, r.timestamp) for r in back) == sorted((r[1], r[2], r[3]) for r in rows)


def test_a_chat_of_several_files_is_one_chat(spark, tmp_path, messages):
    names = ["a b", "c/d%20+", "é=1", None]
    rows = [(names[i % 4], f"S{i % 3}", f"m{i}\nx", 1714573800 + 60 * (i // 2), "text", i) for i in range(400)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "30")
    try:
        X.write_exports(messages(rows), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    back = X.read_exports(spark, str(tmp_path / "out")).collect()
    want, place = [], {}
    for c, s, t, at, k, _ in rows:
        place[c] = place.get(c, 0) + 1
        want.append((c, s, t, at, k, place[c]))
    assert sorted(((r.chat_id, r.sender, r.content, r.timestamp, r.type, r.line_number) for r in back), key=str) == sorted(want, key=str)


def test_hashes_and_duplicates(spark, tmp_path):
    for name, body in [("a.txt", "um"), ("b.txt", "um"), ("c.txt", "dois")]:
        (tmp_path / name).write_text(body)
    files = X.file_hashes(spark, str(tmp_path))
    assert {r.file_hash for r in files.collect()} == {hashlib.sha256(b.encode()).hexdigest() for b in ("um", "dois")}
    known = files.filter("chat_name = 'c'").select("file_hash")
    assert [r.file.split("/")[-1] for r in store.new_files(files, known).collect()] == ["a.txt"]


def test_roots_of_files_of_any_size(spark, tmp_path):
    """Equal files have equal roots in whatever splits they are read; one byte, one line end or one line more is another root."""
    text = "".join(f"linha {i} {'x' * (i % 9)}\n" for i in range(1, 700))
    bodies = {"a.txt": text, "copy.txt": text, "byte.txt": text.replace("linha 350", "linha 35O"), "less.txt": text[:-1], "more.txt": text + "\n",
              "crlf.txt": text.replace("\n", "\r\n"), "small.txt": "um", "empty.txt": ""}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    seen = []
    for split, whole in ((1 << 20, 1 << 30), (900, 1000), (333, 1)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        try:
            got = {r.file.split("/")[-1]: (r.size, r.root) for r in X.file_roots(spark, str(tmp_path), fan=7, whole_file_bytes=whole).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]
    roots = {n: r for n, (_, r) in seen[0].items()}
    assert roots["a.txt"] == roots["copy.txt"] and len(set(roots.values())) == 6
    assert {n: s for n, (s, _) in seen[0].items()} == {n: len(b.encode()) for n, b in bodies.items() if b}


def test_unzip_takes_the_first_text_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("__MACOSX/._chat.txt", "no")
        z.writestr("pic.jpg", "no")
        z.writestr("chat.txt", "01/05/2024 14:30 - A: é")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("pic.jpg", "no")
    texts = X.unzip_exports(spark, str(tmp_path / "*.zip"))
    assert [r.text for r in texts.collect()] == ["01/05/2024 14:30 - A: é"]
    assert P.parse_lines(X.split_lines(texts, "file", "text")).first()["content"] == "é"


def test_json_chats(spark, tmp_path):
    chat = {"name": "c", "messages": [{"from": "A", "date": "2024-05-01T14:30:00", "text": " oi "}, {"from": None, "date": "x", "text": None}]}
    (tmp_path / "r.json").write_text(json.dumps(chat, indent=1))
    rows = X.read_json_chats(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [(r.sender, r.content, r.timestamp, r.type) for r in rows] == [("A", "oi", 1714573800, "text"), ("", "", None, "system")]


def test_folders_of_small_files_are_listed_by_few_tasks(spark, tmp_path, messages):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.unset(key)
    X.write_exports(messages([(f"c{i}", "A", "um", 1714573800, "text", 1) for i in range(40)]), str(tmp_path / "out"))
    lines = X.read_lines(spark, str(tmp_path / "out"))
    assert int(spark.conf.get(key)) <= max(32, 4 * spark.sparkContext.defaultParallelism)
    assert lines.columns == ["file", "block", "split", "line_number", "line"] and lines.count() == 40


def test_writing_has_a_task_per_core(spark, tmp_path, messages):
    rows = messages([(f"c{i:02d}", "A", "um", 1714573800 + i, "text", i) for i in range(64)])
    for split in (True, False):
        X.write_exports(rows, str(tmp_path / f"{split}"), split=split)
        parts = {f.name.split("-")[1] for f in (tmp_path / f"{split}").glob("*/*.txt")}
        assert len(parts) > 1
