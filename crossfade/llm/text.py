"""Helpers for texts inside tasks: whole texts, a bounded piece at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that a task splits into words at once.
PIECE = 1 << 20
_BLANK = b" \t\n\r\x0b\x0c"


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 of each text; empty for NULL."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``text`` cut at ASCII white space into pieces of about ``size`` bytes.

    No word is cut: a word beyond ``size`` makes its piece as long as it is.
    """
    if len(text) <= size:
        yield text
        return
    start = 0
    while start < len(text):
        end = start + size
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        yield text[start:end]
        start = end
