"""String expressions.  All of them are plain column expressions, so they stay
inside whole-stage code generation."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions import constants as K

# White space as JavaScript's trim() sees it (wider than Spark's trim).
SPACE_CLASS = r"[\s\u000B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

TOKEN = r"[\p{L}\p{N}]+"


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their bare letter, from the canonical
    decompositions of Latin-1 and the Latin extensions.  Combining marks follow,
    without a partner: translating drops them."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)
        if ch == ch.lower() and len(base) > 1 and base[0].isascii():
            marked.append(ch)
            plain.append(base[0])
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


ACCENTED, PLAIN = _accent_table()


def js_trim(s: Column) -> Column:
    """Only strings with space at an end are searched for it.  In regular expressions the
    end may stand before a last line break, and U+0085 is one."""
    ends = F.concat(F.substring(s, 1, 1), F.substring(s, -1, 1))
    bare = F.regexp_replace(s, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    return F.when(ends.rlike(f"{SPACE_CLASS}|\\x85"), bare).otherwise(s)


def is_blank(s: Column) -> Column:
    return ~s.rlike(SPACE_CLASS.replace("[", "[^", 1))


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units, which is what a JavaScript length is.  Plain ASCII,
    the common case, needs no encoding to tell."""
    chars = F.length(s)
    encoded = (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")
    return F.when(F.octet_length(s) == chars, chars.cast("long")).otherwise(encoded)


def utf16_at_least(s: Column, n: int) -> Column:
    """Whether the UTF-16 length reaches n; most strings are decided by the
    number of characters alone."""
    return F.when(F.length(s) >= n, F.lit(True)).otherwise(utf16_length(s) >= n)


def token_estimate(s: Column) -> Column:
    """About four characters per token, rounded up."""
    return F.ceil(F.coalesce(utf16_length(s), F.lit(0)) / 4).cast("long")


def fold(s: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(s), ACCENTED, PLAIN)


def search_tokens(s: Column) -> Column:
    return F.regexp_extract_all(fold(s), F.lit(TOKEN), F.lit(0))


def clean_keyword(s: Column, keep_spaces: bool = True) -> Column:
    """Runs of what stays are joined: they are fewer than what goes."""
    drop = K.KEYWORD_DROP if keep_spaces else K.KEYWORD_DROP_NO_SPACE
    stays = drop.replace("[^", "[", 1) + "+"
    return F.trim(F.array_join(F.regexp_extract_all(s, F.lit(stays), F.lit(0)), ""))


def clean_keywords(a: Column, keep_spaces: bool = True) -> Column:
    cleaned = F.transform(a, lambda k: clean_keyword(k, keep_spaces))
    return F.filter(cleaned, lambda k: k != "")


def keywords_or_text(keywords: Column, text: Column) -> Column:
    """An empty keyword list means: search for the whole query text."""
    empty = keywords.isNull() | (F.size(keywords) == 0)
    return F.when(empty, F.array(text)).otherwise(keywords)


def union_keywords(*lists: Column) -> Column:
    out = lists[0]
    for other in lists[1:]:
        out = F.array_union(out, F.coalesce(other, F.array().cast("array<string>")))
    return F.array_distinct(out)


def matches_any(s: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns occurs.  A pattern that is plain text is looked
    up in the lower-cased string; another is tried only where its longest piece of
    plain text occurs.  Regular expressions thus see few strings."""
    low = F.lower(s)
    hit = F.lit(False)
    for pattern in patterns:
        body = pattern.removeprefix("(?iu)")
        if body == pattern:
            hit = hit | s.rlike(pattern)
        elif re.fullmatch(r"[\w <>-]+", body):
            hit = hit | F.contains(low, F.lit(body.lower()))
        else:
            piece = max(re.findall(r"[a-zà-ÿ ]{4,}", body), key=len)
            hit = hit | (F.contains(low, F.lit(piece)) & s.rlike(pattern))
    return hit


def message_type(content: Column, sender: Column) -> Column:
    body = js_trim(content)
    return (
        F.when(matches_any(body, K.MEDIA_PATTERNS), "media")
        .when(matches_any(body, K.SYSTEM_PATTERNS), "system")
        .when(sender.isNull() | is_blank(sender), "system")
        .otherwise("text")
    )


def iso_instant(epoch: Column) -> Column:
    """Needs a UTC session time zone, as does every formatting below."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clock(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "HH:mm")


def day_label(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "dd/MM/yyyy")


def stable_id(*parts: Column) -> Column:
    """Deterministic key: rerunning a job gives the same ids."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def chat_name(path: Column) -> Column:
    """Base name of a (percent-encoded) path without its last extension."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.element_at(F.split(decoded, "/"), -1), r"\.[^/.]+$", "")


def term_words(s: Column) -> Column:
    """Words of a message for term statistics."""
    bare = F.translate(F.lower(s), K.TERM_PUNCTUATION, "")
    return F.filter(
        F.split(bare, f"{SPACE_CLASS}+"),
        lambda w: utf16_at_least(w, 2) & ~w.isin(K.STOPWORDS),
    )


def pairs_of(left: Column, words: Column, skip: int) -> Column:
    """Each element of `left` followed by the word `skip` places further on."""
    size = F.greatest(F.size(words) - skip, F.lit(0))
    return F.zip_with(
        F.slice(left, F.lit(1), size), F.slice(words, F.lit(skip + 1), size),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def single_grams(words: Column) -> Column:
    """Words long enough to be terms of their own; longer grams always are."""
    return F.filter(words, lambda w: utf16_at_least(w, 3))


def highlight(content: Column, query: Column) -> Column:
    """Wrap every query word found in the content in <mark>."""
    words = F.filter(F.split(query, f"{SPACE_CLASS}+"), lambda w: w != "")
    escaped = F.transform(
        words, lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    )
    pattern = F.concat(F.lit("(?iu)("), F.array_join(escaped, "|"), F.lit(")"))
    marked = F.regexp_replace(content, pattern, F.lit("<mark>$1</mark>"))
    return F.when(F.size(words) == 0, content).otherwise(marked)


def initials(name: Column) -> Column:
    firsts = F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1))
    return F.upper(F.substring(F.array_join(firsts, ""), 1, 2))


def first_word(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def day_and_month(epoch: Column) -> Column:
    at = F.timestamp_seconds(epoch)
    month = F.element_at(F.array(*[F.lit(m) for m in K.SHORT_MONTHS]), F.month(at))
    return F.concat(F.date_format(at, "dd"), F.lit(" de "), month)


def relative_time(epoch: Column, now: Column) -> Column:
    minutes = F.floor((now - epoch) / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(epoch.isNull() | (epoch == 0), "—")
        .when(minutes < 1, "agora")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("min atrás")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h atrás")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d atrás")))
        .otherwise(day_and_month(epoch))
    )


def fill(template: str, **parts: Column | str) -> Column:
    """A text template with {name} places as a column."""
    pieces = re.split(r"\{(\w+)\}", template)
    named = [F.col(parts[p]) if isinstance(parts[p], str) else parts[p] for p in pieces[1::2]]
    texts = [F.lit(p) for p in pieces[::2]]
    return F.concat(*[c for pair in zip(texts, [*named, F.lit("")]) for c in pair])
