"""Secrets in texts, also below layers of encoding.

A text is searched as it is; then what is encoded in it (percent escapes, backslash
escapes, base64, deflate or gzip data inside base64) is unwrapped and goes the same way,
until nothing new appears.  Escapes are unwrapped in the whole layer at once, so a key
and its value meet although blanks or quotes stand between them, and also run by run.
Base64 is read over line ends and from all four alignments, so letters glued to its
front do no harm; bytes that are no UTF-8 stand as single characters and spoil nothing
else.  A layer whose content was already seen around the same place is not entered
twice, so data that unpacks to itself ends.  Each layer knows from which characters of
the text each of its own came, so every find has a span in the text.

Nulls and edges: a null text counts as empty and has no finds.  Rows are judged one
by one; repeated rows get equal answers.  Finds of equal kind and span are told
once; a find seen in two layers may be told with two spans that overlap.  Layers of
base64 are entered, and counted in `n_layers`, only if they hold a find or something
encoded.  Compressed data is read to its end, all gzip members, in overlapping windows;
what is entered and unpacks to more than a window of `LAYER_BYTES` is counted in
`n_oversize`.  Other
columns are passed through unread.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Unpacked data is searched in windows of this size, which share OVERLAP bytes.
LAYER_BYTES, OVERLAP = 64 << 20, 1 << 20
#: The fewest base64 letters that are tried: the shortest find has 12 bytes.
BASE64_RUN = 16
#: Base64 letters that are decoded at a time on the way to an inflater.
PIECE = 1 << 16

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Longest runs: a run begins where no letter of the class stands before.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PERCENT = re.compile(r"""[^\s"'<>%]*%[0-9A-Fa-f]{2}[^\s"'<>]*""")
_ESCAPED = re.compile(r"""[^\s"'<>\\]*\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})[^\s"'<>]*""")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_PERCENTS = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_LETTER = "[A-Za-z0-9+/_-]"
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-]){_LETTER}{{{BASE64_RUN},}}")
_LINE_END = re.compile(r"\n|\\n")
_LETTERS = re.compile(rf"{_LETTER}+")
_LETTERS_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
# How gzip and zlib data begins in base64; raw deflate data has no mark and is tried
# where a run, a line, or what follows one of / - _ + begins.
_PACKED = re.compile(r"(?=H4sI|eAE|eF[4-7]|eJ[w-z]|eN[o-r])")
_INNER = re.compile(r"(?<=[/_+-])(?![/_+-])")

Span = tuple[int, int, int]  # start, kind, end


def find(text: str) -> list[Span]:
    """Finds in one layer, leftmost and non-overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """A piece of unwrapped text, and for each of its characters the characters of
    the root text it stands for (arrays; None in the root)."""

    __slots__ = ("text", "starts", "ends", "seen")

    def __init__(self, text, starts, ends, seen):
        self.text, self.starts, self.ends, self.seen = text, starts, ends, seen


def _unescape(text: str, at: int, end: int, pattern: re.Pattern, read) -> tuple[str, np.ndarray, np.ndarray] | None:
    """Replace what `pattern` matches in text[at:end]; None if nothing could be."""
    out, starts, ends, changed = [], [], [], False
    place = at

    def plain(to: int) -> None:
        out.append(text[place:to])
        starts.append(np.arange(place, to))
        ends.append(np.arange(place + 1, to + 1))

    for m in pattern.finditer(text, at, end):
        got = read(m)
        if got is None:
            continue
        plain(m.start())
        out += [letter for letter, _, _ in got]
        starts.append(np.array([m.start() + a for _, a, _ in got]))
        ends.append(np.array([m.start() + b for _, _, b in got]))
        place, changed = m.end(), True
    if not changed:
        return None
    plain(end)
    return "".join(out), np.concatenate(starts), np.concatenate(ends)


def _width(c: str) -> int:
    """Bytes that a decoded character was; one that is no UTF-8 is a lone surrogate."""
    return 1 if "\udc80" <= c <= "\udcff" else len(c.encode())


def _percents(m: re.Match):
    letters = bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape")
    out, at = [], 0
    for c in letters:
        n = _width(c)
        out.append((c, 3 * at, 3 * (at + n)))
        at += n
    return out


def _escape(m: re.Match):
    code = int(m.group(1) or m.group(2), 16)
    return None if 0xD800 <= code < 0xE000 else [(chr(code), 0, len(m.group()))]


def _decoded(run: str) -> bytes:
    """The bytes of base64 letters; one letter too many is left out."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _inflate(run: str, at: int, bits: int, most: int) -> Iterator[tuple[bytes, int]]:
    """What the base64 letters from `at` on unpack to, in parts of at most `most` bytes,
    and with the last part of each gzip member the letter where it ends, else 0.  Stops
    where the data is damaged or cut off."""
    unpack, raw, size, start, fed = zlib.decompressobj(bits), b"", 64, at, 0
    while raw or at < len(run):
        if at < len(run) and len(raw) < PIECE:
            more = _decoded(run[at : at + size])
            raw, fed, at, size = raw + more, fed + len(more), at + size, min(PIECE, 4 * size)
        if unpack.eof:
            # Another member may follow, also after zeros.
            raw = raw.lstrip(b"\0")
            if len(raw) < 2 and at < len(run):
                continue
            if bits != 31 or raw[:2] != b"\x1f\x8b":
                return
            unpack = zlib.decompressobj(bits)
        try:
            part = unpack.decompress(raw, most)
        except zlib.error:
            return
        raw = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
        yield part, start - (-(fed - len(raw)) * 4 // 3) if unpack.eof else 0
    if not unpack.eof:
        try:
            yield unpack.flush(), 0
        except zlib.error:
            return


def _windows(parts: Iterator[tuple[bytes, int]]) -> Iterator[bytes]:
    """Parts joined to windows of LAYER_BYTES, each with the end of the one before."""
    held, fresh = bytearray(), False
    for part, _ in parts:
        held += part
        fresh = fresh or bool(part)
        while len(held) >= LAYER_BYTES:
            yield bytes(held[:LAYER_BYTES])
            del held[: LAYER_BYTES - OVERLAP]
            fresh = len(held) > OVERLAP
    if fresh:
        yield bytes(held)


def _holds(text: str) -> bool:
    """Whether a layer has a find or something encoded."""
    return bool(find(text) or "%" in text and _PERCENTS.search(text) or "\\" in text and _ESCAPE.search(text)
                or next(_runs(text), None) is not None)


def _runs(text: str) -> Iterator[np.ndarray]:
    """Places of the letters of every base64 run, and of runs joined over line ends."""
    for m in _BASE64.finditer(text):
        yield np.arange(m.start(), m.end())
    lines: list[tuple[int, int]] = []
    for m in _LINE_END.finditer(text):
        end, start, n = m.start(), m.end(), len(text)
        if text.endswith("\r", 0, end):
            end -= 1
        elif text.endswith("\\r", 0, end):
            end -= 2
        while end and text[end - 1] in " \t":
            end -= 1
        while start < n and text[start] in " \t":
            start += 1
        if not end or text[end - 1] not in _LETTERS_SET or start == n or text[start] not in _LETTERS_SET:
            continue
        if not lines or lines[-1][1] != end:
            yield from _joined(lines)
            at = end
            while at and text[at - 1] in _LETTERS_SET:
                at -= 1
            lines = [(at, end)]
        lines.append((start, _LETTERS.match(text, start).end()))
    yield from _joined(lines)


def _joined(lines: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    if sum(b - a for a, b in lines) >= BASE64_RUN:
        yield np.concatenate([np.arange(a, b) for a, b in lines])


def _base64(text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray, bool]]:
    """Texts of the base64 runs of a layer, with their maps, and whether one was larger
    than a window."""
    for places in _runs(text):
        # In one piece, or the letters of each line.
        a, b = int(places[0]), int(places[-1]) + 1
        run = text[a:b] if b - a == len(places) else "".join(map(text.__getitem__, places.tolist()))
        run = run.replace("-", "+").replace("_", "/")
        for shift in range(4):
            got = _decoded(run[shift:]).decode("utf-8", "surrogateescape")
            if _holds(got):
                n = np.ones(len(got), np.int64) if got.isascii() else np.array([_width(c) for c in got])
                end = np.cumsum(n)
                first, last = shift + (end - n) * 4 // 3, shift - (-end * 4 // 3)
                yield got, places[first], places[np.minimum(last, len(places)) - 1] + 1, False
        lines = (np.flatnonzero(np.diff(places) > 1) + 1).tolist()
        tries = [(m.start(), 31 if run.startswith("H4sI", m.start()) else 15) for m in _PACKED.finditer(run)]
        tries += [(i, -15) for i in sorted({0, *lines, *(m.start() for m in _INNER.finditer(run))})]
        for i, bits in tries:
            stop, size = 0, 0
            for part, end in _inflate(run, i, bits, PIECE):
                stop, size = max(stop, end), size + len(part)
            # Without a mark only data that comes to its end counts.
            if not stop and bits < 0:
                continue
            last = int(places[min(stop or len(run), len(run)) - 1]) + 1
            while text.startswith("=", last):
                last += 1
            large = size > LAYER_BYTES
            for window in _windows(_inflate(run, i, bits, LAYER_BYTES)):
                got = window.decode("utf-8", "surrogateescape")
                if _holds(got):
                    yield got, np.broadcast_to(places[i], len(got)), np.broadcast_to(np.int64(last), len(got)), large
                    large = False


def unwrap(layer: _Layer, known: set) -> Iterator[tuple[_Layer, bool]]:
    """The layers directly below one, and whether each begins data larger than a window.
    `known` has what was entered from the same characters of the root text."""
    text = layer.text

    def below(got: str, starts: np.ndarray, ends: np.ndarray, large: bool = False) -> Iterator[tuple[_Layer, bool]]:
        digest = hashlib.blake2b(got.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if digest in layer.seen:
            return
        if layer.starts is not None:
            starts, ends = layer.starts[starts], layer.ends[ends - 1]
        where = hashlib.blake2b(digest, digest_size=16)
        where.update(np.ascontiguousarray(starts))
        where.update(np.ascontiguousarray(ends))
        if where.digest() not in known:
            known.add(where.digest())
            yield _Layer(got, starts, ends, layer.seen | {digest}), large

    for sign, piece, pattern, read in (("%", _PERCENT, _PERCENTS, _percents), ("\\", _ESCAPED, _ESCAPE, _escape)):
        if sign in text and (got := _unescape(text, 0, len(text), pattern, read)):
            yield from below(*got)
            for m in piece.finditer(text):
                if got := _unescape(text, m.start(), m.end(), pattern, read):
                    yield from below(*got)
    for got in _base64(text):
        yield from below(*got)


def scan(text: str) -> tuple[list[Span], list[Span], int, int]:
    """(finds in the text itself, all finds, layers entered, those in several windows)."""
    base = find(text)
    every = set(base)
    known: set = set()
    # Depth first, so that only one window of each depth is held.
    work = [unwrap(_Layer(text, None, None, frozenset()), known)]
    entered = oversize = 0
    while work:
        layer, large = next(work[-1], (None, False))
        if layer is None:
            work.pop()
            continue
        entered += 1
        oversize += large
        for start, kind, end in find(layer.text):
            every.add((int(layer.starts[start:end].min()), kind, int(layer.ends[start:end].max())))
        work.append(unwrap(layer, known))
    return base, sorted(every), entered, oversize


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every find replaced; overlapping finds become one mask."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_oversize long"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def scan_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows without their text, with what was found in it."""
    kept = [c for c in docs.columns if c != text and c not in _NAMES]

    def judge(batches):
        for batch in batches:
            out = []
            for value in batch.column(text):
                base, every, entered, oversize = scan(value.as_py() or "")
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2),
                            hashlib.sha256(written(base).encode()).hexdigest(), written(every), entered, oversize))
            columns = list(zip(*out, strict=True)) or [()] * len(_NAMES)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *map(pa.array, columns, kinds)], [*kept, *_NAMES])

    schema = docs.select(*kept).schema
    for part in RESULT.split(", "):
        schema = schema.add(*part.split())
    return docs.select(*kept, text).mapInArrow(judge, schema)


def redact_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with secrets masked; a null text stays null."""

    def clean(batches):
        for batch in batches:
            texts = [v if v is None else redact(v, scan(v)[1]) for v in batch.column(text).to_pylist()]
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, text, pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(clean, docs.schema)
