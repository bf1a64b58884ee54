"""Dates as people write them in a question: "ontem", "semana passada", "10 de março",
"nos últimos 3 dias", "desde segunda-feira".  Calendar arithmetic against a given now.

Texts are looked at in lower case without accents.  Every mention gives a first and a last
day; a word before it may leave one side open.  Several mentions span from the earliest to
the latest day.  Dates that do not exist are no mention.  Days are days of UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import text as T

MONTHS = "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split()
WEEKDAYS = "segunda terca quarta quinta sexta sabado domingo".split()
NUMBERS = "um dois tres quatro cinco seis sete oito nove dez".split()

_MONTH, _DAY = "|".join(MONTHS), "|".join(WEEKDAYS)
_COUNT = r"(?:\d{1,3}|uma|duas|" + "|".join(NUMBERS) + ")"
_UNIT = "(?:dias?|semanas?|mes(?:es)?|anos?)"
# Forms of a mention; of two that begin at one place the earlier in the list is taken.
FORMS = {
    "iso": r"\d{4}-\d{2}-\d{2}",
    "slashed": r"\d{1,2}/\d{1,2}(?:/\d{4})?",
    "day": rf"\d{{1,2}} de (?:{_MONTH})(?: de \d{{4}})?",
    "month": rf"(?:{_MONTH})(?: de \d{{4}})?",
    "near": "anteontem|ontem|hoje",
    "before": "(?:semana|mes|ano) passad[oa]|ultim[oa] (?:semana|mes|ano)",
    "current": "(?:nest|ness|est|ess)[ea] (?:semana|mes|ano)",
    "weekend": "fim de semana",
    "span": rf"ultim[oa]s {_COUNT} {_UNIT}",
    "ago": rf"ha {_COUNT} {_UNIT}|{_COUNT} {_UNIT} atras",
    "weekday": rf"(?:{_DAY})(?:-feira| feira)?",
    "year": r"em (?:19|20)\d{2}",
}
_OPEN = "(?:(?:desde|ate|antes de|antes d[oa]|depois de|depois d[oa]|apos) (?:[oa]s? )?(?:dia )?)?"
MENTION = rf"\b{_OPEN}(?:{'|'.join(FORMS.values())})\b"


def mentions(text: Column) -> Column:
    """The mentions in the order of the text, in lower case without accents."""
    return F.regexp_extract_all(T.fold(text), F.lit(MENTION), F.lit(0))


def without_dates(text: Column) -> Column:
    """The text in lower case without accents and without its mentions of dates."""
    return F.trim(F.regexp_replace(T.fold(text), MENTION, " "))


def _group(m: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract(m, pattern, n)


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if the calendar has none."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(month), two(day)), "yyyy-MM-dd")


def _number(digits: Column) -> Column:
    """Digits or a number word as a number; 0 for neither."""
    word = F.regexp_replace(F.regexp_replace(digits, "^uma$", "um"), "^duas$", "dois")
    listed = F.array_position(F.array(*[F.lit(n) for n in NUMBERS]), word).cast("int")
    return F.coalesce(digits.try_cast("int"), listed)


def _latest(make, today: Column, given: Column) -> Column:
    """The date of the given year, or of the latest year in which it is not after today."""
    this = make(F.year(today))
    return F.when(given != "", make(given.try_cast("int"))).when(this > today, make(F.year(today) - 1)).otherwise(this)


def _back(today: Column, many: Column, unit: Column) -> Column:
    """A number of units before today."""
    return (
        F.when(unit.startswith("dia"), F.date_sub(today, many)).when(unit.startswith("semana"), F.date_sub(today, many * 7))
        .when(unit.startswith("mes"), F.add_months(today, -many)).otherwise(F.add_months(today, -many * 12))
    )


def _span(mention: Column, today: Column) -> Column:
    """first and last day of a mention without its opening word."""
    core = F.regexp_replace(mention, rf"^{_OPEN}", "")
    is_form = lambda name: core.rlike(rf"^(?:{FORMS[name]})$")
    both = lambda first, last=None: F.struct(first.cast("date").alias("first"), (first if last is None else last).cast("date").alias("last"))
    place = lambda name, names: F.array_position(F.array(*[F.lit(n) for n in names]), name).cast("int")
    ahead = lambda first, months: F.date_sub(F.add_months(first, months), 1)

    iso = F.try_to_date(core, "yyyy-MM-dd")
    dmy = r"^(\d{1,2})/(\d{1,2})(?:/(\d{4}))?$"
    part = lambda n: _group(core, dmy, n).try_cast("int")
    slashed = _latest(lambda y: _day(y, part(2), part(1)), today, _group(core, dmy, 3))
    named = rf"^(?:(\d{{1,2}}) de )?({_MONTH})(?: de (\d{{4}}))?$"
    month, year = place(_group(core, named, 2), MONTHS), _group(core, named, 3)
    day = _latest(lambda y: _day(y, month, _group(core, named, 1).try_cast("int")), today, year)
    first_of = _latest(lambda y: _day(y, month, F.lit(1)), today, year)
    before = lambda d, k: F.date_sub(d, F.pmod(F.weekday(d) - k - 1, F.lit(7)) + 1)
    sunday = before(today, F.lit(6))
    unit = _group(core, "(semana|mes|ano)")
    start_of = lambda d: F.when(unit == "semana", F.trunc(d, "week")).when(unit == "mes", F.trunc(d, "month")).otherwise(F.trunc(d, "year"))
    opening = start_of(today)
    earlier = start_of(F.date_sub(opening, 1))
    counted = rf"({_COUNT}) ({_UNIT})"
    back = _back(today, _number(_group(core, counted)), _group(core, counted, 2))
    whole = _day(_group(core, r"(\d{4})").try_cast("int"), F.lit(1), F.lit(1))
    return (
        F.when(is_form("iso"), both(iso)).when(is_form("slashed"), both(slashed)).when(is_form("day"), both(day))
        .when(is_form("month"), both(first_of, ahead(first_of, 1)))
        .when(core == "anteontem", both(F.date_sub(today, 2))).when(core == "ontem", both(F.date_sub(today, 1))).when(core == "hoje", both(today))
        .when(is_form("before"), both(earlier, F.date_sub(opening, 1))).when(is_form("current"), both(opening, today))
        .when(is_form("weekend"), both(F.date_sub(sunday, 1), sunday))
        .when(is_form("span"), both(back, today)).when(is_form("ago"), both(back))
        .when(is_form("weekday"), both(before(today, place(_group(core, f"^({_DAY})"), WEEKDAYS) - 1)))
        .when(is_form("year"), both(whole, ahead(whole, 12)))
    )


def _opened(mention: Column, span: Column) -> Column:
    """The span with the side that the opening word leaves open as null."""
    none = F.lit(None).cast("date")
    side = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    return (
        F.when(mention.startswith("desde "), side(span["first"], none)).when(mention.startswith("ate "), side(none, span["last"]))
        .when(mention.startswith("antes "), side(none, F.date_sub(span["first"], 1)))
        .when(mention.rlike("^(?:depois|apos) "), side(F.date_add(span["last"], 1), none)).otherwise(span)
    )


def with_date_range(df: DataFrame, text: Column, now: Column) -> DataFrame:
    """Add date_from and date_to, seconds since 1970 of the first and the last second; 0
    where a side is open or nothing is mentioned.  now: seconds since 1970."""
    found = df.withColumn("__today", F.to_date(F.timestamp_seconds(now))).withColumn("__said", mentions(text))
    paired = F.transform("__said", lambda m: F.struct(m.alias("m"), _span(m, F.col("__today")).alias("s")))
    found = found.withColumn("__spans", F.transform(F.filter(paired, lambda p: p["s"]["first"].isNotNull()), lambda p: _opened(p["m"], p["s"])))
    seconds = lambda d: F.unix_date(d).cast("long") * 86400
    first = F.array_min(F.transform("__spans", lambda s: s["first"]))
    last = F.array_max(F.transform("__spans", lambda s: s["last"]))
    return found.withColumns({
        "date_from": F.coalesce(seconds(first), F.lit(0).cast("long")),
        "date_to": F.coalesce(seconds(last) + 86399, F.lit(0).cast("long")),
    }).drop("__today", "__said", "__spans")


def mentioned_days(df: DataFrame, text: Column, now: Column) -> DataFrame:
    """A row per mention with its first_day and last_day; words that leave a side open are
    not looked at."""
    found = df.withColumn("__today", F.to_date(F.timestamp_seconds(now))).withColumn("__said", mentions(text))
    spans = F.transform("__said", lambda m: _span(m, F.col("__today")))
    rows = found.withColumn("__span", F.explode(spans)).filter(F.col("__span.first").isNotNull())
    return rows.withColumns({"first_day": F.col("__span.first"), "last_day": F.col("__span.last")}).drop("__today", "__said", "__span")
