"""Frequent numbers from packed lists, and terms that are counted through them."""

import random
from collections import Counter

import numpy as np
import pytest

from chatloom.operators import often, stats
from tests.test_growth import MESSAGE, plan


@pytest.mark.parametrize("bits,n", [(0, 5), (1, 4), (9, 0), (9, 1), (9, 700), (37, 3000), (62, 50)])
def test_lists_come_back_as_they_were(bits, n):
    numbers = np.sort(np.random.default_rng(n).integers(0, 1 << bits, n, np.int64))
    low, body = often.packed(numbers, bits)
    assert often.unpacked(body, n, low).tolist() == numbers.tolist()
    assert len(body) * 8 <= n * (low + 4) + 8 * (low + 2)


@pytest.mark.parametrize("chunk", [1 << 22, 16])
def test_frequent_numbers_pass_the_filter(spark, monkeypatch, chunk):
    monkeypatch.setattr(often, "CHUNK", chunk)
    draw = random.Random(3)
    said = [draw.randrange(400) * 7919 for _ in range(900)] + [5, 5, 5, (1 << 22) - 1]
    numbers = spark.createDataFrame([(x,) for x in said], "h long").repartition(3)
    lists, inner = often.frequent(numbers, 22, 3, len(said))
    found = [x | r.at << inner for r in lists.collect() for x in often.unpacked(r.body, r.n, r.low).tolist()]
    wanted = {x for x, n in Counter(said).items() if n >= 3}
    assert len(found) == len(set(found)) and set(found) == wanted
    words = often.bit_filter(lists, 22, inner, 1 << 16)
    passed = numbers.filter(often.may_hold(words.scalar(), stats.F.col("h"), 22, 1 << 16))
    left = {r.h for r in passed.collect()}
    assert wanted <= left and len(left - wanted) < len(set(said) - wanted) / 10


def talk(spark):
    draw = random.Random(8)
    words = ["gato", "rio", "casa", "lua", "mar", "sol"]
    said = [(draw.choice("ab"), draw.choice(["ana", "rui"]), " ".join([*draw.choices(words, k=3), f"so{i}"]), 100 + i % 40, "text", i) for i in range(80)]
    return spark.createDataFrame(said + said[:10] + [("b", "ana", None, 7, "text", 1), (None, None, "gato gato", None, "text", None)], MESSAGE)


def test_terms_do_not_depend_on_the_filter(spark, monkeypatch):
    rows = lambda: sorted(map(str, stats.term_stats(talk(spark)).collect()))
    wanted = rows()
    # A filter that all pass, and hashes that meet.
    monkeypatch.setattr(stats, "MOST_SLOTS", 64)
    monkeypatch.setattr(stats, "LEAST_SLOTS", 64)
    monkeypatch.setattr(stats, "VALUES_A_BYTE", 0)
    assert rows() == wanted and wanted


def test_hashes_are_counted_without_a_row_for_each(spark, monkeypatch):
    """Before, every different hash of a task was shuffled as a row of its own."""
    made = []
    whole = often.frequent
    monkeypatch.setattr(stats, "frequent", lambda *a: made.append(whole(*a)) or made[-1])
    told = stats.term_stats(talk(spark))
    assert made[0][0].count() == 1
    # Sums of a sender are dealt by term as they are.
    assert "REPARTITION_BY_COL" in plan(told)


def test_only_texts_of_listed_places_are_grouped(spark):
    """Before, the texts of all messages were."""
    messages = talk(spark)
    terms = stats.ranked_terms(stats.term_stats(messages), 2)
    found = stats.sample_messages(messages, terms)
    assert "LeftSemi" in plan(found)
    said = {(r.chat_id, f"[{r.sender}]: {r.content}") for r in messages.collect()}
    rows = found.collect()
    assert rows and all((r.chat_id, r.sample) in said and r.term in r.sample for r in rows)


def test_a_short_list_is_sent_to_the_messages(spark):
    """Before, all messages went to their chat's task with all their terms."""
    messages = talk(spark)
    told = stats.cooccurrences(messages, stats.term_stats(messages))
    assert "rightHint=(strategy=broadcast)" in plan(told) and told.count()
    facts = stats.profile_facts(messages, messages.select("chat_id").distinct().withColumn("contact_name", stats.F.upper("chat_id")))
    assert {r.category for r in facts.collect()} == {"frequent_term", "co_occurrence"}
