import pytest
from pyspark.sql import functions as F

from chatloom.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize("value, want", [(" ﻿a b \n", "a b"), (" x", "x"), ("", "")])
def test_trim_removes_all_spaces(spark, value, want):
    assert one(spark, value, T.js_trim) == want


@pytest.mark.parametrize("value, want", [("abc", 3), ("é", 1), ("a😀", 3), ("", 0)])
def test_length_is_in_utf16_units(spark, value, want):
    assert one(spark, value, T.utf16_length) == want


@pytest.mark.parametrize("value, n, want", [("ab", 3, False), ("a😀", 3, True), ("éé", 3, False), ("😀", 2, True)])
def test_at_least(spark, value, n, want):
    assert one(spark, value, lambda s: T.utf16_at_least(s, n)) is want


def test_token_estimate_rounds_up(spark):
    assert one(spark, "abcde", T.token_estimate) == 2


@pytest.mark.parametrize(
    "content, want",
    [
        ("<MÍDIA OCULTA>", "media"), ("foto.JPG (arquivo anexado)", "media"), ("IMG-20240501-WA0001.jpg", "media"),
        ("img-20240501-WA0001", "text"), ("João saiu", "system"), ("ele ésaiu", "system"), ("xsaiu", "text"), ("cleft", "system"),
        ("leftover", "text"), ("Ana added +55", "system"), ("Ana added me", "text"),
        ("Esta MENSAGEM foi apagada", "system"), ("mudou o ÍCONE", "system"), ("oi", "text"),
        ("image omitted saiu", "media"),
    ],
)
def test_message_type(spark, content, want):
    assert one(spark, content, lambda s: T.message_type(s, F.lit("Ana"))) == want


def test_blank_sender_is_system(spark):
    assert one(spark, "oi", lambda s: T.message_type(s, F.lit(" "))) == "system"


def test_fold_and_tokens(spark):
    assert one(spark, "Ação, ÀÉ-x1", T.search_tokens) == ["acao", "ae", "x1"]


def test_keyword_cleaning(spark):
    assert one(spark, " a-b (c) é× ", T.clean_keyword) == "ab c é"
    assert one(spark, "projeto delta", lambda s: T.clean_keyword(s, False)) == "projetodelta"


@pytest.mark.parametrize(
    "path, want",
    [("file:/x/Conversa%20com%20Ana.txt", "Conversa com Ana"), ("file:/x/a+b.v1.txt", "a+b.v1"), ("file:/x/plain", "plain")],
)
def test_chat_name(spark, path, want):
    assert one(spark, path, T.chat_name) == want


def test_highlight_escapes_and_ignores_case(spark):
    assert one(spark, "Use C++ or ÉTÉ", lambda s: T.highlight(s, F.lit("c++ été"))) == (
        "Use <mark>C++</mark> or <mark>ÉTÉ</mark>"
    )
    assert one(spark, "same", lambda s: T.highlight(s, F.lit("  "))) == "same"


@pytest.mark.parametrize(
    "age, want", [(30, "agora"), (60, "1min atrás"), (3599, "59min atrás"), (3600, "1h atrás"), (86400, "1d atrás")]
)
def test_relative_time(spark, age, want):
    got = spark.range(1).select(T.relative_time(F.lit(1_700_000_000 - age), F.lit(1_700_000_000)).alias("r")).first()["r"]
    assert got == want


def test_term_words_and_grams(spark):
    df = spark.createDataFrame([("O Gato, o rato! do (mato) 12",)], "s string").select(T.term_words(F.col("s")).alias("w"))
    row = df.select(
        "w", T.pairs_of(F.col("w"), F.col("w"), 1).alias("two"), T.single_grams(F.col("w")).alias("one"),
        T.pairs_of(T.pairs_of(F.col("w"), F.col("w"), 1), F.col("w"), 2).alias("three"),
    ).first()
    assert row["w"] == ["gato", "rato", "mato", "12"]
    assert row["one"] == ["gato", "rato", "mato"]
    assert row["two"] == ["gato rato", "rato mato", "mato 12"]
    assert row["three"] == ["gato rato mato", "rato mato 12"]


def test_initials(spark):
    assert one(spark, "ana maria silva", T.initials) == "AM"
