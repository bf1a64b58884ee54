"""Byte-level BPE as a streaming transducer with bounded lookahead.

Encoding a prefix of a piece keeps, for each position, only the last token of that
prefix: a token may follow another if no merge across their border would have come
first (`Merges.fits`).  The tokens of the whole are the chain of last tokens read
backwards.  How far to the right a decision can reach follows from the merge list
(`Merges.lookahead`): whether a rule applies depends on what follows only through
rules of higher priority that begin inside its right half.  Tokens that end further
back than that are final and are emitted; the window behind them is dropped, so the
memory for one piece is a constant, whatever the piece's length.

Decoding feeds token bytes to a state machine that holds back at most the three
bytes of an unfinished character.

Nulls and edges: a null text counts as empty (no tokens, empty text back).  Rows are
handled one by one; repeated rows get equal answers; other columns pass unread.  A
special token's own string in a text is that token, as the tokenizer file has it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chatloom.llm.common import chunks

#: Entries of the table of short pieces that a task remembers.
REMEMBERED = 700_000
SHORT = 48

# The piece pattern is a fixed value of the tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WIDE = regex.compile(PIECES.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_PLAIN = re.compile(PIECES.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.A)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself
    where it is printable Latin-1, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary and its merges by priority."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letter = byte_letters()
        vocab = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letter[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        born: dict[int, int] = {}
        for place, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = place
            if whole not in self.parts:
                self.parts[whole] = (a, b)
                born[whole] = place
        self.born = born
        self.by_bytes = {raw: i for i, raw in self.bytes_of.items() if (len(raw) == 1 or i in self.parts)}
        self.longest = max(map(len, self.by_bytes))
        self.tails = self._tails()
        self.lookahead = self._lookahead()
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._known: dict[tuple[int, int], bool] = {}

    def _tails(self) -> dict[bytes, int]:
        """For every byte string that ends a token: the longest token length with it,
        so that a search from the right knows when to stop."""
        far: dict[bytes, int] = {}
        for raw in self.by_bytes:
            for k in range(1, min(len(raw), 3) + 1):
                far[raw[-k:]] = max(far.get(raw[-k:], 0), len(raw))
        return far

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that touch one end of a token while it grows, each with the
        priority of the merge that uses it up."""
        never = len(self.rank)
        out = [(token, never)]
        while token in self.parts:
            out.append((self.parts[token][side], self.born[token]))
            token = self.parts[token][side]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their bytes stand side by side."""
        known = self._known.get((a, b))
        if known is None:
            if len(self._known) > 2_000_000:
                self._known.clear()
            if a not in self._right:
                self._right[a] = self._spine(a, 1)
            if b not in self._left:
                self._left[b] = self._spine(b, 0)
            lefts, rights = self._right[a], self._left[b]
            known = True
            for x, until in lefts:
                for y, till in rights:
                    place = self.rank.get((x, y))
                    # Of equal merges the left one is first.
                    if place is not None and place < until and place <= till:
                        known = False
                        break
                if not known:
                    break
            self._known[a, b] = known
        return known

    def spell(self, raw: bytes, last: list[int] | None = None) -> list[int]:
        """The tokens of a piece that is shorter than the lookahead: the transducer's
        steps with the whole piece as its window.  `last` holds the last tokens of the
        prefixes that are known from another piece, and gets those of the others."""
        find, known, tails, fits = self.by_bytes.get, self._known.get, self.tails.get, self.fits
        n = len(raw)
        last = [0] if last is None else last
        for end in range(len(last), n + 1):
            far = tails(raw[end - 3 if end > 3 else 0 : end], self.longest)
            for start in range(end - far if end > far else 0, end):
                token = find(raw[start:end])
                if token is None:
                    continue
                if start:
                    apart = known((last[start], token))
                    if not (fits(last[start], token) if apart is None else apart):
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the merge list cannot spell this byte")
        out, size = [], self.bytes_of
        while n:
            out.append(last[n])
            n -= len(size[last[n]])
        return out[::-1]

    def spell_all(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """The tokens of sorted pieces.  The last token of a prefix depends on nothing
        after it, so pieces that begin alike share those steps."""
        before, last = b"", [0]
        for raw in pieces:
            same, most = 0, min(len(raw), len(before))
            while same < most and raw[same] == before[same]:
                same += 1
            del last[same + 1 :]
            yield self.spell(raw, last)
            before = raw

    def _lookahead(self) -> int:
        """Bytes after a token's end that can still change it.  reach(rule) is how far
        from its own start a rule's use depends on the text: its length, or through a
        rule of higher priority that starts at a part of its right half."""
        size = {i: len(raw) for i, raw in self.bytes_of.items()}
        furthest: dict[int, int] = {}
        most = 1
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            reach = whole = size[a] + size[b]
            x = b
            while True:
                reach = max(reach, whole - size[x] + furthest.get(x, 0))
                if x not in self.parts:
                    break
                x = self.parts[x][1]
            furthest[a] = max(furthest.get(a, 0), reach)
            most = max(most, reach)
        return most


class Transducer:
    """Takes the bytes of one piece part by part; gives tokens as they become final."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.text = bytearray()  # the window
        self.last: list[int] = [-1]  # last[i]: last token of the text up to i in the window
        self.floor = -1  # the token before the window

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        m, room = self.m, 2 * self.m.lookahead + 2 * self.m.longest
        for at in range(0, len(raw), room):
            self._extend(raw[at : at + room])
            if len(self.text) > room:
                out += self._emit(len(self.text) - m.lookahead)
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.text))

    def _extend(self, raw: bytes) -> None:
        m, text, last = self.m, self.text, self.last
        begin = len(text)
        text += raw
        for end in range(begin + 1, len(text) + 1):
            far = m.tails.get(bytes(text[max(0, end - 3) : end])) or m.longest
            for start in range(max(0, end - far), end):
                token = m.by_bytes.get(bytes(text[start:end]))
                if token is None:
                    continue
                before = last[start] if start else self.floor
                if start and before < 0:
                    continue
                if before < 0 or m.fits(before, token):
                    last.append(token)
                    break
            else:
                raise ValueError("the merge list cannot spell this byte")

    def _emit(self, upto: int) -> list[int]:
        """Give out the tokens of the chain that end at or before `upto`."""
        chain_, at = [], len(self.text)
        while at > 0:
            token = self.last[at]
            chain_.append((at, token))
            at -= len(self.m.bytes_of[token])
        done = [(end, token) for end, token in reversed(chain_) if end <= upto]
        if done:
            end = done[-1][0]
            self.floor = done[-1][1]
            del self.text[:end]
            self.last = [-1, *self.last[end + 1 :]]
        return [token for _, token in done]


class ByteText:
    """Bytes in, text out; an unfinished character waits for its rest."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _open(raw: bytes) -> int:
        """How many bytes at the end begin a character that could still be completed."""
        for k in range(1, min(3, len(raw)) + 1):
            b = raw[-k]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            if need <= k:
                return 0
            if k > 1:
                second = raw[-k + 1]
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                if not low <= second <= high:
                    return 0
            return k
        return 0

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        k = self._open(raw)
        self.held = raw[len(raw) - k :]
        return raw[: len(raw) - k].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Coder(dict):
    """Encodes and decodes texts; remembers the tokens of short pieces."""

    def __init__(self, path: str):
        super().__init__()
        self.merges = Merges(path)
        self.shown = {i: str(i) for i in self.merges.bytes_of}
        names = sorted(self.merges.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        if len(piece) <= SHORT:
            got = self[piece] = tuple(self.merges.spell(raw))
        else:
            machine = Transducer(self.merges)
            got = tuple(machine.feed(raw) + machine.finish())
        return got

    def cut(self, text: str) -> list[tuple[bool, list[str]]]:
        """The text's pieces in order, special tokens marked and apart."""
        parts = self.split.split(text) if self.split and "<" in text else [text]
        return [(True, [part]) if i % 2 else (False, (_PLAIN if part.isascii() else _WIDE).findall(part))
                for i, part in enumerate(parts) if part]

    def learn(self, texts: list[list[tuple[bool, list[str]]]]) -> None:
        """Spell the short pieces of cut texts that are not known yet, in their order."""
        if len(self) > REMEMBERED:
            self.clear()
        new = {p for parts in texts for special, pieces in parts if not special for p in pieces}.difference(self)
        # By code point is by UTF-8 byte.
        short = sorted(p for p in new if len(p) <= SHORT)
        for piece, ids in zip(short, self.merges.spell_all([p.encode() for p in short]), strict=True):
            self[piece] = tuple(ids)

    def spelled(self, parts: list[tuple[bool, list[str]]]) -> list[int]:
        out: list[int] = []
        for special, pieces in parts:
            if special:
                out.append(self.merges.special[pieces[0]])
            else:
                out.extend(chain.from_iterable(map(self.__getitem__, pieces)))
        return out

    def encode(self, text: str) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        return self.spelled(self.cut(text))

    def decode(self, ids: list[int], step: int = 1 << 16) -> str:
        machine, out = ByteText(), []
        for at in range(0, len(ids), step):
            out.append(machine.feed(b"".join(map(self.merges.bytes_of.__getitem__, ids[at : at + step]))))
        return "".join(out) + machine.finish()


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder per Python worker."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows without their text, with the tokens' number and digest, and the
    digest of the text decoded from them."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c != text and c not in names]

    def work(batches):
        c = coder(path)
        for batch in chunks(batches, text):
            out = []
            texts = [c.cut(value or "") for value in batch.column(text).to_pylist()]
            c.learn(texts)
            for parts in texts:
                ids = c.spelled(parts)
                shown = ",".join(map(c.shown.__getitem__, ids))
                out.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(),
                            hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), *map(pa.array, columns, (pa.int64(), pa.string(), pa.string()))],
                [*kept, *names])

    schema = docs.select(*kept).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select(*kept, text).mapInArrow(work, schema)
