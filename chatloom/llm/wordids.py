"""Ids of texts under a lower-casing BPE vocabulary with word ends, many words at a time.

The vocabulary's rules never join anything across white space, so a text's ids are those
of its words.  Words seen before are looked up; the others are spelled side by side: in
every step each word joins its pair of best rank wherever it stands, until no word has a
pair left.  Texts with letters beyond Latin-1, control characters that only some count as
blank, or what may be a special token are given to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from chatloom.llm.bpe import byte_letters

#: Words a worker remembers before it starts anew.
REMEMBERED = 1_500_000
ODD = "\x1c\x1d\x1e\x1f"
ID_BYTES = 4

# How the vocabulary's tokenizer cuts Latin-1 text in small letters; fixed by its file.
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Pairs:
    """Rank and result of each pair of the merge list, in a table with open slots."""

    BITS = 18

    def __init__(self, pairs: np.ndarray, results: np.ndarray):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.zeros(1 << self.BITS, np.int32)
        left, rank = pairs, np.arange(len(pairs), dtype=np.int32)
        self.results = results
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left[free]
            self.ranks[slot[free]] = rank[free]
            # Of pairs that want one slot the last one has it, the others move on.
            lost = self.keys[slot] != left
            left, rank, slot = left[lost], rank[lost], slot[lost] + 1 & len(self.keys) - 1
        # The rank that stands beside a key must be its own.
        order = self.rank_of(pairs)
        if not (order == np.arange(len(pairs))).all():
            raise ValueError("the merge list names a pair twice")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges if it is none."""
        out = np.full(len(keys), len(self.results), np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            there = self.keys[slot]
            hit = there == keys[rest]
            out[rest[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there >= 0)
            rest, slot = rest[on], slot[on] + 1 & len(self.keys) - 1
        return out


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.pairs = Pairs(
            np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64),
            np.array([vocab[a + b] for a, b in merges], np.int64))
        self.inner, self.final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.inner[byte], self.final[byte] = vocab[letter], vocab[letter + end]
        self.known: dict[str, bytes] = {}

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        n = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids, word = self.inner[raw], np.repeat(np.arange(n), sizes)
        last = np.cumsum(sizes) - 1
        ids[last] = self.final[raw[last]]
        none = len(self.pairs.results)
        done_ids, done_words = [], []
        while len(ids):
            rank = np.full(len(ids), none, np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.pairs.rank_of(ids[inside] * self.size + ids[inside + 1])
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(heads, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, heads), lengths)
            settled = best == none
            done_ids.append(ids[settled])
            done_words.append(word[settled])
            ids, word, rank, best = ids[~settled], word[~settled], rank[~settled], best[~settled]
            if not len(ids):
                break
            hit = np.flatnonzero(rank == best)
            # Where equal pairs overlap, as in three equal tokens, every second one goes, from the left.
            new = np.append(True, hit[1:] != hit[:-1] + 1)
            from_first = np.arange(len(hit)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            hit = hit[from_first % 2 == 0]
            ids[hit] = self.pairs.results[rank[hit]]
            stays = np.ones(len(ids), bool)
            stays[hit + 1] = False
            ids, word = ids[stays], word[stays]
        word = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        return ids[np.argsort(word, kind="stable")].astype("<u4"), np.bincount(word, minlength=n)

    def learn(self, words: list[str]) -> None:
        # Mostly a word is one piece.
        pieces = [[w] if w.isascii() and w.isalpha() else _LATIN.findall(w) for w in words]
        ids, counts = self.spell([p.encode() for found in pieces for p in found])
        raw, ends = ids.tobytes(), (np.concatenate(([0], np.cumsum(counts))) * ID_BYTES).tolist()
        at = 0
        for word, found in zip(words, pieces, strict=True):
            self.known[word] = raw[ends[at] : ends[at + len(found)]]
            at += len(found)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut, new = [], set()
        for text in texts:
            low = text.lower()
            plain = "<|" not in low and is_latin(low) and not any(c in low for c in ODD)
            cut.append(low.split() if plain else None)
            if plain:
                new.update(cut[-1])
        new = new.difference(self.known)
        if new:
            self.learn(list(new))
        return [
            np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if words is None
            else b"".join(map(self.known.__getitem__, words))
            for text, words in zip(texts, cut, strict=True)
        ]
