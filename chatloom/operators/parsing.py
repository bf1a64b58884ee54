"""Export lines to message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import constants as K
from chatloom.functions import text as T
from chatloom.operators.ordered import Ordered
from chatloom.session import slices_for_hot_groups


def patterns_for(regional: bool = False) -> dict[str, str]:
    return {**K.LINE_PATTERNS, **K.REGIONAL_PATTERNS} if regional else dict(K.LINE_PATTERNS)


def line_format(line: Column, patterns: dict[str, str]) -> Column:
    """The first format whose pattern the line has, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return F.when(line.rlike(K.LINE_OPENS), out)


def detect_formats(lines: DataFrame, regional: bool = False) -> DataFrame:
    """file, format, and for files whose first lines have no known format null."""
    found = line_format(T.js_trim(F.col("line")), patterns_for(regional))
    head = lines.filter(F.col("line_number") <= K.DETECTION_LINES).withColumn("__f", found)
    return head.groupBy("file").agg(
        F.min_by("__f", F.when(F.col("__f").isNotNull(), F.col("line_number"))).alias("format")
    )


def unknown_formats(files: DataFrame, format_column: str = "format") -> DataFrame:
    """Files that name a format nobody knows."""
    return files.filter(~F.col(format_column).isin(list(patterns_for(True))))


def epoch_seconds(fmt: Column, date: Column, time: Column) -> Column:
    """Calendar fields to epoch seconds; fields out of range roll over, and
    seconds are dropped."""
    parts = F.split(date, "[/.\\-]")
    first, second = parts[0].cast("int"), parts[1].cast("int")
    month_first = fmt.isin(K.MONTH_FIRST_FORMATS)
    month = F.when(month_first, first).otherwise(second)
    day = F.when(month_first, second).otherwise(first)
    raw_year = parts[2].cast("int")
    year = (
        F.when(raw_year < 70, raw_year + 2000).when(raw_year < 100, raw_year + 1900).otherwise(raw_year)
    )
    clock = F.split(F.regexp_replace(time, r"\s*[AP]M", ""), ":")
    hour, minute = clock[0].cast("int"), clock[1].cast("int")
    hour = (
        F.when(time.endswith("PM") & (hour != 12), hour + 12)
        .when(time.endswith("AM") & (hour == 12), 0)
        .otherwise(hour)
    )
    month_start = F.make_date(
        (year + F.floor((month - 1) / 12)).cast("int"), F.pmod(month - 1, F.lit(12)) + 1, F.lit(1)
    )
    days = F.unix_date(month_start).cast("long") + day - 1
    return days * 86400 + hour * 3600 + minute * 60


def _is_start() -> Column:
    starts = F.lit(False)
    for name, pattern in patterns_for(True).items():
        starts = F.when(F.col("format") == name, F.col("line").rlike(pattern)).otherwise(starts)
    return starts


def _number_whole(lines: DataFrame, regional: bool) -> DataFrame:
    """Files of ordinary size: format and message numbers come from windows over
    the file, and later steps group by the same key, so lines are shuffled once."""
    by_line = Window.partitionBy("file").orderBy("line_number")
    head = F.when(
        F.col("line_number") <= K.DETECTION_LINES, line_format(T.js_trim(F.col("line")), patterns_for(regional))
    )
    whole = by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        lines.withColumn("__f", head)
        .withColumn("format", F.first("__f", ignorenulls=True).over(whole)).drop("__f")
        .withColumn("__start", _is_start())
        .withColumn("message_no", F.sum(F.col("__start").cast("long")).over(upto))
    )


def _number_split(lines: DataFrame, regional: bool) -> DataFrame:
    """Files too large for one task: formats are joined, and message numbers are
    summed up block by block (or slice by slice)."""
    known = lines.join(detect_formats(lines, regional), "file", "left").withColumn("__start", _is_start())
    if "block" in lines.columns:
        rows = Ordered(known, ("file",), ("line_number",), slice="block")
    else:
        rows = Ordered.over(known, ["file"], ["line_number"])
    return rows.running_sum(F.col("__start").cast("long"), "message_no").result()


NUMBERED = ["file", "format", "line_number", "line", "message_no", "__start"]


def _numbered(lines: DataFrame, regional: bool) -> list[DataFrame]:
    """Lines with their file's format (null if unknown) and the number of the
    message they belong to; 0 is before the first message."""
    if "split" in lines.columns:
        parts = [
            _number_whole(lines.filter(~F.col("split")), regional),
            _number_split(lines.filter("split"), regional),
        ]
    elif slices_for_hot_groups(lines, ["file"]):
        parts = [_number_split(lines, regional)]
    else:
        parts = [_number_whole(lines, regional)]
    return [p.select(NUMBERED) for p in parts]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assemble(numbered: DataFrame) -> DataFrame:
    """Message rows: a starting line and the non-blank lines that follow it."""
    kept = numbered.filter((F.col("message_no") > 0) & (F.col("__start") | ~T.is_blank(F.col("line"))))
    grouped = kept.groupBy("file", "format", "message_no").agg(
        F.min("line_number").alias("line_number"),
        F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("__lines"),
    )
    texts = F.transform("__lines", lambda x: x["line"])
    head = F.col("__head")

    def group(n: int) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in patterns_for(True).items():
            out = F.when(F.col("format") == name, F.regexp_extract(head, pattern, n)).otherwise(out)
        return out

    rows = (
        grouped.withColumn("__head", F.col("__lines")[0]["line"])
        .withColumn("raw", F.array_join(texts, "\n"))
        .withColumn("__date", group(1))
        .withColumn("__time", group(2))
        .withColumn("sender", T.js_trim(group(3)))
        # The content group ends the line, so the rest of `raw` follows it as is.
        .withColumn(
            "content",
            T.js_trim(F.concat(group(4), F.expr("substring(raw, length(__head) + 1)"))),
        )
    )
    return rows.select(
        F.col("file").alias("chat_id"), "sender", "content",
        epoch_seconds(F.col("format"), F.col("__date"), F.col("__time")).alias("timestamp"),
        T.message_type(F.col("content"), F.col("sender")).alias("type"),
        "line_number", "raw",
    )


def parse_lines(lines: DataFrame, regional: bool = False) -> DataFrame:
    return _union([assemble(p) for p in _numbered(lines, regional)])


def _is_orphan() -> Column:
    return F.col("format").isNotNull() & (F.col("message_no") == 0) & ~T.is_blank(F.col("line"))


def parse_errors(lines: DataFrame, regional: bool = False) -> DataFrame:
    """Lines before the first message, and files of no known format."""
    orphans = _union(
        [
            p.filter(_is_orphan()).select("file", "line_number", "line", F.lit("orphan_line").alias("reason"))
            for p in _numbered(lines, regional)
        ]
    )
    unknown = detect_formats(lines, regional).filter("format is null").select(
        "file", F.lit(None).cast("long").alias("line_number"),
        F.lit(None).cast("string").alias("line"), F.lit("unknown_format").alias("reason"),
    )
    return orphans.unionByName(unknown)


def parse_stats(lines: DataFrame, regional: bool = False) -> DataFrame:
    """One row per file; first and last time are those of file order."""
    return _union([_stats(p) for p in _numbered(lines, regional)])


def _stats(numbered: DataFrame) -> DataFrame:
    totals = numbered.groupBy("file").agg(
        F.max("format").alias("format"),
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(_is_orphan()).alias("error_count"),
    )
    messages = assemble(numbered).groupBy(F.col("chat_id").alias("file")).agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_distinct("sender").alias("participant_count"),
        F.min_by("timestamp", "line_number").alias("first_timestamp"),
        F.max_by("timestamp", "line_number").alias("last_timestamp"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return totals.join(messages, "file", "left").select(
        "file", "format", "total_lines", zero("total_messages"), "error_count",
        zero("participant_count"), "first_timestamp", "last_timestamp",
    )


def participants(messages: DataFrame) -> DataFrame:
    """Senders of a chat in the order they first appear, one row each."""
    first = messages.groupBy("chat_id", "sender").agg(
        F.min("line_number").alias("first_line"), F.count(F.lit(1)).alias("message_count")
    )
    return Ordered.over(first, ["chat_id"], ["first_line", "sender"]).row_number("position").result()
