"""Trimming, blank lines, keywords and formats are the ones of the plain expressions, without searching every character."""

import re

from pyspark.sql import functions as F

from chatloom.functions import constants as K
from chatloom.functions import text as T
from chatloom.operators import parsing as P

EDGES = ["", " ", "\n", "\r\n", "\t", " ", "　", "﻿", "\u0085", " \u0085", "\u0085 ", " ", "  \n\u0085\n", "​"]
INNER = ["", "a", "a b", "é ü", "😀", "😀 x", "!?", "01/05/2024 14:30 - A: m", "[1/5/24, 2:30:11 PM] A: m"]


def test_texts_are_as_the_plain_expressions_make_them(spark):
    texts = [(a + b + c,) for a in EDGES for b in INNER for c in EDGES] + [(None,)]
    s = F.col("s")
    plain = F.regexp_replace(s, f"^{T.SPACE_CLASS}+|{T.SPACE_CLASS}+$", "")
    was = F.lit(None).cast("string")
    for name, pattern in reversed(P.patterns_for(True).items()):
        was = F.when(plain.rlike(pattern), name).otherwise(was)
    drop = lambda p: F.trim(F.regexp_replace(s, p, ""))
    pairs = [
        (T.js_trim(s), plain), (T.is_blank(s), plain == ""), (P.line_format(T.js_trim(s), P.patterns_for(True)), was),
        (T.clean_keyword(s), drop(K.KEYWORD_DROP)), (T.clean_keyword(s, False), drop(K.KEYWORD_DROP_NO_SPACE)),
    ]
    df = spark.createDataFrame(texts, "s string").repartition(3)
    for i, (now, before) in enumerate(pairs):
        assert df.filter(~now.eqNullSafe(before)).collect() == [], i
    assert df.filter(was.isNotNull()).count() > 0


def test_characters_that_go_are_not_replaced_one_by_one(spark):
    plan = spark.range(1).select(T.clean_keyword(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and re.search("regexp_extract_all", plan)
