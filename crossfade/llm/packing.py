"""Cost-balanced packing of documents into sequences of a fixed length.

A piece of ``n`` tokens costs ``linear * n + quadratic * n ** 2``: attention
sees the tokens of its own piece only. Each task packs the documents of its
partition, about ``BLOCK_TOKENS`` at a time: no shuffle, bounded memory, and
nothing that a lost executor has to share. Within a block

1. documents of a sequence's length or more give whole sequences;
2. what is left goes, longest first, to the cheapest sequence with room for it;
3. what fits nowhere is cut to fill the cheapest sequences with room;
4. what is less than a sequence in the end goes on with the next block, and
   at the end of a partition into sequences of falling powers of two.

Every sequence is therefore full, or as long as a power of two: no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfade.llm.text import byte_texts
from crossfade.llm.tokens import opened

#: Tokens packed together; more gives better balance for more memory.
BLOCK_TOKENS = 1 << 20
_WIDTH = 4  # bytes of an id
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class _Piece:
    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id, start: int, doc_tokens: int, ids: memoryview):
        self.doc_id, self.start, self.doc_tokens, self.ids = doc_id, start, doc_tokens, ids

    def __len__(self) -> int:
        return len(self.ids) // _WIDTH

    def cut(self, n: int) -> tuple[_Piece, _Piece | None]:
        """The first ``n`` tokens and the others."""
        if n == len(self):
            return self, None
        rest = _Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n * _WIDTH :])
        return _Piece(self.doc_id, self.start, self.doc_tokens, self.ids[: n * _WIDTH]), rest


class Packer:
    """Packs the pieces of one partition; :meth:`rows` gives what has been placed."""

    def __init__(self, first_sequence: int, capacity: int, linear: float, quadratic: float):
        self._capacity, self._linear, self._quadratic = capacity, linear, quadratic
        self._next, self._waiting, self._placed = first_sequence, [], []
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> None:
        piece = _Piece(doc_id, 0, len(ids) // _WIDTH, memoryview(ids))
        while piece is not None and len(piece) >= self._capacity:
            whole, piece = piece.cut(self._capacity)
            self._place([whole])
        if piece is not None:
            self._waiting.append(piece)
            self.tokens += len(piece)

    def _place(self, pieces: list[_Piece]) -> None:
        offset = 0
        for piece in pieces:
            self._placed.append((piece, self._next, offset))
            offset += len(piece)
        self._next += 1

    def _cost(self, n: int) -> float:
        return self._linear * n + self._quadratic * n * n

    def settle(self) -> None:
        """Fill as many sequences as the waiting tokens fill; the rest waits on."""
        n = self.tokens // self._capacity
        room, cost = np.full(n, self._capacity), np.zeros(n)
        sequences: list[list[_Piece]] = [[] for _ in range(n)]

        def give(at: int, piece: _Piece) -> None:
            sequences[at].append(piece)
            room[at] -= len(piece)
            cost[at] += self._cost(len(piece))

        left = []
        for piece in sorted(self._waiting, key=len, reverse=True):
            open_cost = np.where(room >= len(piece), cost, np.inf)
            at = int(open_cost.argmin()) if n else 0
            if n and open_cost[at] < np.inf:
                give(at, piece)
            else:
                left.append(piece)
        self._waiting = []
        for piece in left:
            while piece is not None and n and room.any():
                at = int(np.where(room > 0, cost, np.inf).argmin())
                part, piece = piece.cut(min(len(piece), int(room[at])))
                give(at, part)
            if piece is not None:
                self._waiting.append(piece)
        self.tokens = sum(map(len, self._waiting))
        for pieces in sequences:
            self._place(pieces)

    def finish(self) -> None:
        """Place what waits: full sequences, then falling powers of two."""
        self.settle()
        waiting = self._waiting[::-1]
        while self.tokens:
            size, pieces = 1 << self.tokens.bit_length() - 1, []
            self.tokens -= size
            while size:
                piece = waiting.pop()
                part, rest = piece.cut(min(size, len(piece)))
                size -= len(part)
                pieces.append(part)
                if rest is not None:
                    waiting.append(rest)
            self._place(pieces)
        self._waiting = []

    def rows(self) -> pa.RecordBatch:
        """The pieces placed since the last call."""
        placed, self._placed = self._placed, []
        of = lambda f: pa.array([f(p) for p, _, _ in placed], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                of(lambda p: p.doc_id),
                of(lambda p: p.start),
                of(len),
                of(lambda p: p.doc_tokens),
                pa.array([s for _, s, _ in placed], pa.int64()),
                pa.array([o for _, _, o in placed], pa.int64()),
                pa.array([bytes(p.ids) for p, _, _ in placed], pa.binary()),
            ],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of documents and their places: :data:`SCHEMA`, one row per piece.

    ``tokenizer`` is the path of a vocabulary file that every executor has. A
    document's tokens are those of its whole text and ``end_id`` behind them,
    so NULL and empty texts have one. Every token lies in exactly one piece;
    ``ids`` holds a piece's ids, four little-endian bytes each; ``offset`` runs
    gapless from 0 within ``sequence_id``. ``capacity`` is a power of two.
    Repeated rows, repeated and NULL ids are packed as documents of their own;
    ties in length keep the rows' order. An empty table gives no rows.
    """
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    end = end_id.to_bytes(_WIDTH, "little")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = opened(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, linear, quadratic)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                packer.add(doc_id, words.encode(text) + end)
                if packer.tokens >= block_tokens:
                    packer.settle()
                    yield packer.rows()
            yield packer.rows()  # whole sequences of long documents don't wait
        packer.finish()
        yield packer.rows()

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(compute, SCHEMA)
