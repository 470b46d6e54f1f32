"""Token ids of whole texts with a file of a public tokenizer."""

from __future__ import annotations

import struct

from tokenizers import Tokenizer

from crossfade.llm.text import pieces

#: Words whose ids a worker keeps: half of them of late, the others as long as they are met again.
KEPT_WORDS = 400_000


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as they are and the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of a tokenizer that drops white space and ignores case, a word at a time.

    No token of such a file crosses white space, so the ids of a text are those
    of its words, and a word's ids are worked out once. Latin words, with full
    stops or commas behind them, go straight to the merges; any other word goes
    through the whole tokenizer. The ids equal those of encoding the whole text
    with ``add_special_tokens=False``.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        self._whole = Tokenizer.from_file(path)
        self._merges = self._whole.model
        self._alphabet = _byte_alphabet()
        self._kept_words = kept_words
        self._known: dict[bytes, bytes] = {}
        self._before: dict[bytes, bytes] = {}
        self._ends: dict[bytes, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack("<%dI" % len(ids), *ids)

    def _learn(self, word: bytes) -> bytes:
        """The ids of a word not met of late."""
        if (ids := self._before.get(word)) is not None:
            return ids
        body = word.rstrip(b".,")
        if body.isalpha():  # ASCII letters
            letters = body.decode().lower()
        else:
            letters = body.decode().lower()
            if not letters.isalpha() or max(letters) >= "\u0250":
                return self._packed(self._whole.encode(word.decode(), add_special_tokens=False).ids)
            letters = letters.encode().decode("latin-1").translate(self._alphabet)
        if len(body) == len(word):
            return self._packed([t.id for t in self._merges.tokenize(letters)])
        known = self._known.get(body) or self._before.get(body)
        if known is None:
            known = self._known[body] = self._packed([t.id for t in self._merges.tokenize(letters)])
        end = word[len(body) :]
        if end not in self._ends:
            self._ends[end] = self._packed(self._whole.encode(end.decode(), add_special_tokens=False).ids)
        return known + self._ends[end]

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text, four little-endian bytes each."""
        out = []
        for piece in pieces(text):
            # control strings count in their own case only
            words = (piece if b"<|" in piece else piece.lower()).split()
            if len(self._known) > self._kept_words // 2:
                self._before, self._known = self._known, {}
            known = self._known
            for word in set(words).difference(known):
                known[word] = self._learn(word)
            out.append(b"".join(map(known.__getitem__, words)))
        return b"".join(out)


_opened: dict[str, WordTokenizer] = {}


def opened(path: str) -> WordTokenizer:
    """The tokenizer of ``path``, opened once in a worker."""
    if path not in _opened:
        _opened[path] = WordTokenizer(path)
    return _opened[path]
