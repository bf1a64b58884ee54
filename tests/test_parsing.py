import calendar

import pytest
from pyspark.sql import functions as F

from chatloom.operators import parsing as P
from chatloom.sources import exports as X


def parse(spark, text, regional=False):
    texts = spark.createDataFrame([("f", text)], "file string, text string")
    lines = X.split_lines(texts, "file", "text")
    return P.parse_lines(lines, regional).orderBy("line_number").collect(), lines


@pytest.mark.parametrize(
    "line, sender, content",
    [
        ("01/05/2024 14:30 - João Silva: Mensagem aqui", "João Silva", "Mensagem aqui"),
        ("01/05/2024, 14:30 - João Silva: Mensagem aqui", "João Silva", "Mensagem aqui"),
        ("5/1/24, 2:30 PM - John Smith: Message here", "John Smith", "Message here"),
        ("[5/1/24, 2:30:45 PM] John Smith: Message here", "John Smith", "Message here"),
        ("01/05/2024 14:30 - Dr. João: Silva: Mensagem", "Dr. João", "Silva: Mensagem"),
        ("01/05/2024 14:30 - +55 11 99999-9999: Oi", "+55 11 99999-9999", "Oi"),
        ("01/05/2024 14:30 - João 🎮: Oi", "João 🎮", "Oi"),
    ],
)
def test_formats(spark, line, sender, content):
    rows, _ = parse(spark, line)
    assert [(r.sender, r.content, r.timestamp) for r in rows] == [(sender, content, 1714573800)]


def test_empty_body_with_trailing_space_is_a_message(spark):
    rows, _ = parse(spark, "01/05/2024 14:29 - A: um\n01/05/2024 14:30 - João Silva: ")
    assert [(r.sender, r.content) for r in rows] == [("A", "um"), ("João Silva", "")]
    # Detection trims its lines, so alone such a line has no known format.
    assert parse(spark, "01/05/2024 14:30 - João Silva: ")[0] == []


@pytest.mark.parametrize("line", ["01.05.24, 14:30 - Jörg: Hallo", "1/5/24 14:30 - Inés: Hola"])
def test_regional_formats(spark, line):
    rows, _ = parse(spark, line, regional=True)
    assert [r.timestamp for r in rows] == [1714573800]


def test_multiline_message_drops_blank_lines(spark):
    rows, _ = parse(spark, "01/05/2024 14:30 - A: um\r\ndois\n\n  \ntrês\n01/05/2024 14:31 - B: x\n")
    assert [(r.content, r.line_number) for r in rows] == [("um\ndois\ntrês", 1), ("x", 6)]
    assert rows[0].raw == "01/05/2024 14:30 - A: um\ndois\ntrês"


def test_line_without_space_after_colon_continues(spark):
    rows, _ = parse(spark, "01/05/2024 14:30 - A: um\n01/05/2024 14:31 - João:")
    assert [r.content for r in rows] == ["um\n01/05/2024 14:31 - João:"]


def test_bom_and_orphans(spark):
    rows, lines = parse(spark, "﻿01/05/2024 14:30 - A: um")
    assert len(rows) == 1
    _, lines = parse(spark, "01/05/2024 14:32 - Você saiu\n\n01/05/2024 14:30 - A: um")
    errors = P.parse_errors(lines).collect()
    assert [(e.line_number, e.reason) for e in errors] == [(1, "orphan_line")]
    stats = P.parse_stats(lines).first()
    assert (stats.total_lines, stats.total_messages, stats.error_count) == (3, 1, 1)


def test_unknown_format_after_twenty_lines(spark):
    _, lines = parse(spark, "\n".join(["x"] * 20 + ["01/05/2024 14:30 - A: um"]))
    assert [e.reason for e in P.parse_errors(lines).collect()] == ["unknown_format"]
    assert P.parse_lines(lines).count() == 0


def test_first_matching_line_decides_the_format(spark):
    _, lines = parse(spark, "x\n  5/1/24, 2:30 PM - A: b\n01/05/2024 14:30 - A: um")
    assert P.detect_formats(lines).first()["format"] == "android_en"


@pytest.mark.parametrize(
    "fmt, date, time, want",
    [
        ("android_en", "5/1/24", "12:05 AM", (2024, 5, 1, 0, 5)), ("android_en", "5/1/24", "12:05 PM", (2024, 5, 1, 12, 5)),
        ("android_en", "5/1/69", "1:00 AM", (2069, 5, 1, 1, 0)), ("android_en", "5/1/70", "1:00 AM", (1970, 5, 1, 1, 0)),
        ("android_br", "32/13/2024", "10:00", (2025, 2, 1, 10, 0)), ("android_br", "29/02/2023", "25:61", (2023, 3, 2, 2, 1)),
        ("android_br", "00/00/2024", "00:00", (2023, 11, 30, 0, 0)),
    ],
)
def test_epoch_seconds(spark, fmt, date, time, want):
    got = spark.range(1).select(P.epoch_seconds(F.lit(fmt), F.lit(date), F.lit(time)).alias("r")).first()["r"]
    assert got == calendar.timegm((*want, 0))


def test_unknown_format_ids(spark):
    files = spark.createDataFrame([("a", "ios_en"), ("b", "nope")], "file string, format string")
    assert [r.file for r in P.unknown_formats(files).collect()] == ["b"]
