"""Dates in questions against days counted by hand."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from chatloom.functions import dates

# A Thursday.
NOW = int(datetime(2024, 3, 14, 15, 30, tzinfo=timezone.utc).timestamp())
CASES = [
    ("o que rolou ontem?", "2024-03-13", "2024-03-13"),
    ("Anteontem e hoje", "2024-03-12", "2024-03-14"),
    ("resumo da semana passada", "2024-03-04", "2024-03-10"),
    ("na última semana", "2024-03-04", "2024-03-10"),
    ("esta semana", "2024-03-11", "2024-03-14"),
    ("mês passado", "2024-02-01", "2024-02-29"),
    ("nesse mês", "2024-03-01", "2024-03-14"),
    ("ano passado", "2023-01-01", "2023-12-31"),
    ("no fim de semana", "2024-03-09", "2024-03-10"),
    ("nos últimos 3 dias", "2024-03-11", "2024-03-14"),
    ("últimos dois meses", "2024-01-14", "2024-03-14"),
    ("há duas semanas", "2024-02-29", "2024-02-29"),
    ("5 dias atrás", "2024-03-09", "2024-03-09"),
    ("há 1 ano", "2023-03-14", "2023-03-14"),
    ("na quinta-feira", "2024-03-07", "2024-03-07"),
    ("na quarta", "2024-03-13", "2024-03-13"),
    ("no domingo", "2024-03-10", "2024-03-10"),
    ("em março", "2024-03-01", "2024-03-31"),
    ("em abril", "2023-04-01", "2023-04-30"),
    ("em fevereiro de 2021", "2021-02-01", "2021-02-28"),
    ("dia 10 de maio", "2023-05-10", "2023-05-10"),
    ("10 de março de 2020", "2020-03-10", "2020-03-10"),
    ("14/03", "2024-03-14", "2024-03-14"),
    ("15/03", "2023-03-15", "2023-03-15"),
    ("31/02/2020 ou 31/12/2020", "2020-12-31", "2020-12-31"),
    ("2024-01-05", "2024-01-05", "2024-01-05"),
    ("de 01/02 a 05/02", "2024-02-01", "2024-02-05"),
    ("entre janeiro e fevereiro", "2024-01-01", "2024-02-29"),
    ("desde segunda-feira", "2024-03-11", None),
    ("até ontem", None, "2024-03-13"),
    ("antes de março", None, "2024-02-29"),
    ("depois de 10/03", "2024-03-11", None),
    ("desde janeiro até ontem", "2024-01-01", "2024-03-13"),
    ("em 2022", "2022-01-01", "2022-12-31"),
    ("31/02/2020", None, None),
    ("sem data, 2022 gatos, marco zero no ontemzinho" .replace("marco", "m4rco"), None, None),
    ("", None, None),
    (None, None, None),
]


def seconds(day, last=False):
    return 0 if day is None else (date.fromisoformat(day) - date(1970, 1, 1)).days * 86400 + (86399 if last else 0)


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, text string")
    return {r.i: r for r in dates.with_date_range(rows, F.col("text"), F.lit(NOW)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_range(found, i):
    text, first, last = CASES[i]
    assert (found[i].date_from, found[i].date_to) == (seconds(first), seconds(last, True)), text


def test_text_without_dates(spark):
    row = spark.createDataFrame([("Falaram do projeto na Semana Passada?",)], "t string")
    assert row.select(dates.without_dates(F.col("t"))).first()[0] == "falaram do projeto na  ?"
