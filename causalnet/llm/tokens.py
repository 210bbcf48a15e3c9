"""Whole-text encoding by a public tokenizer file, with a bounded memory of pieces already seen.

Both pre-tokenizers cut at white space, so a text's ids are those of its pieces. A piece is encoded
by the library once and then looked up; the id arrays are gathered by numpy. Texts for which a cut
could matter (adjacent or unusual white space) go to the library whole, and so do texts that hold one of the file's added
tokens, such as an end mark, in any case of its letters: the library takes these out before it does anything else.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np

#: Pieces in each of the two generations that one Python worker remembers; when the newer is full it
#: replaces the older, so frequent pieces stay. Results don't depend on it.
REMEMBERED = 450_000
_ODD = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    　﻿]")
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,!&%$#*|;:?]*)\Z")
#: A mark after a Latin-1 letter, at the end of a piece, is a pre-token of its own.
_MARK = re.compile(r"[.,!&%$#*|;:?](?=[ \n]|\Z)(?<=[A-Za-zÀ-ÖØ-öø-ÿ].)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet as a translation of Latin-1 characters: bytes that print stand for
    themselves, the others, in order, for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class Encoder:
    """``encode(text)`` gives the ids that ``tokenizers`` gives with add_special_tokens=False."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        marks = [re.match(r"[^\w\s]*", c)[0] for c in added]
        self.hint = os.path.commonprefix(marks)  # what a text with an added token holds, to be searched for first
        self.whole = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces are in lower case by then, so no added token may be seen in them
        self.model = self.tokenizer.model
        self.bytes_model = self.tokenizer.normalizer is None
        self.letters = _byte_letters()
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.seen, self.old = self._generation(), {}
        self.used = 0
        self.flat = np.zeros(1 << 16, self.kind)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.made = 0
        self.new: list = []

    def _generation(self) -> dict:
        encoder = self

        class Seen(dict):
            def __missing__(self, piece: str) -> int:
                k = encoder.old.get(piece)
                if k is None:
                    k = encoder._store(encoder._learn(piece))
                self[piece] = k
                return k

        return Seen()

    def _rotate(self) -> None:
        """The newer generation becomes the older one; what neither holds is dropped."""
        k = np.fromiter(self.seen.values(), np.int64, len(self.seen))
        n = self.length[k]
        ends = np.cumsum(n)
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.start[k] - ends + n, n)]
        self.start, self.length = ends - n, n
        self.used, self.made = len(self.flat), len(k)
        self.old, self.seen = dict(zip(self.seen, range(len(k)))), self._generation()

    def _store(self, ids) -> int:
        self.new.append(ids)
        self.made += 1
        return self.made - 1

    def _flush(self) -> None:
        """What was stored since the last time goes to the arrays."""
        if not self.new:
            return
        n = np.fromiter(map(len, self.new), np.int64, len(self.new))
        first, at, more = self.made - len(n), self.used, int(n.sum())
        while self.made > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(max(len(x), 16), x.dtype)]) for x in (self.start, self.length))
        while at + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), 16), self.kind)])
        self.flat[at : at + more] = np.fromiter(chain.from_iterable(self.new), self.kind, more)
        self.start[first : self.made], self.length[first : self.made] = at + np.cumsum(n) - n, n
        self.used, self.new = at + more, []

    def _ids(self, k: int) -> list[int]:
        late = k - self.made + len(self.new)
        return self.new[late] if late >= 0 else self.flat[self.start[k] : self.start[k] + self.length[k]].tolist()

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, piece: str):
        """Ids of a piece. Latin-1 letters with marks after them are two pre-tokens, each the model's own work."""
        if self.bytes_model and piece.isascii() and piece.removeprefix(" ").isalpha():
            return [t.id for t in self.model.tokenize(piece.replace(" ", self.letters[32]))]
        m = _PLAIN.match(piece)
        if not m or piece in ("", " "):
            return self._library(piece)
        gap, word, marks = m.groups()
        if not self.bytes_model:
            gap = ""
        if word and marks:
            a, b = self.seen[gap + word], self.seen[marks]
            return self._ids(a) + self._ids(b)
        text = gap + word + marks
        if not self.bytes_model:
            text = unicodedata.normalize("NFC", text).lower()
        return [t.id for t in self.model.tokenize(text.translate(self.letters))]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        if self.hint in text and self.added.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind)
        if self.bytes_model:
            if _ODD.search(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
                return np.array(self._library(text), self.kind)
            pieces = _MARK.sub("\0\\g<0>", text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        else:
            if _ODD.search(text):
                return np.array(self._library(text), self.kind)
            if _latin(text):
                text = text.lower()  # one to one there, as in the tokenizer's own normalizer
            pieces = text.replace("\n", " ").split(" ")
        if len(self.seen) > self.remembered:
            self._rotate()
        k = np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))
        self._flush()
        n = self.length[k]
        ends = np.cumsum(n)
        if not ends[-1]:
            return np.zeros(0, self.kind)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[k] - ends + n, n)]


def _latin(text: str) -> bool:
    try:
        return bool(text.encode("latin-1")) or True
    except UnicodeEncodeError:
        return False


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of the file; it outlives the task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
