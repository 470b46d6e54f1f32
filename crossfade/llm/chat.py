"""Chat formatting: a state machine over roles and a declarative template.

A conversation becomes a row of segments whose texts, one after the other, are
the formatted conversation; each segment carries a loss flag. Conversations are
dealt out by id, sorted by turn and streamed, so a task holds one turn at a
time however long the conversation is.

Control strings inside texts are broken by a backslash behind their first
character and backslashes are doubled, so a text can't open or close a turn,
and :func:`read_back` restores every text from the output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id bigint, segment bigint, turn bigint, role string, kind string, text string, loss boolean, valid boolean, start bigint, end bigint"
TURNS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"


@dataclass(frozen=True)
class Template:
    """How turns are marked, who may follow whom, and whose text is learned.

    ``turns`` has the opening and closing of each role, ``other`` the opening,
    the end of the role's name and the closing for any other role. ``follows``
    maps a state to the roles accepted in it and the state each leads to; a
    role not accepted makes its turn invalid and leads where that role leads
    from elsewhere. A conversation has to end in a state of ``ends``.
    """

    turns: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    follows: dict[str, dict[str, str]]
    start: str
    ends: frozenset[str]
    learned: frozenset[str]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = [m for pair in self.turns.values() for m in pair] + list(self.other)
        controls = tuple(sorted({m.strip() for m in marks}))
        for c in controls:
            if len(c) < 2 or "\\" in c or any(c[:i] == c[-i:] for i in range(1, len(c))):
                raise ValueError(f"{c!r} can't be escaped: two characters at least, no backslash, no end like its start")
        openings = [o.strip() for o, _ in self.turns.values()] + [self.other[0].strip()]
        if any(a != b and b.startswith(a) for a in openings for b in openings) or len(set(openings)) < len(openings):
            raise ValueError("openings must differ, and none may start another")
        object.__setattr__(self, "controls", controls)

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The state after ``role``, and whether it was accepted."""
        accepted = self.follows.get(state, {})
        if role in accepted:
            return accepted[role], True
        return next((to[role] for to in self.follows.values() if role in to), state), False

    def marks(self, role: str) -> tuple[str, str]:
        if role in self.turns:
            return self.turns[role]
        opening, named, closing = self.other
        return f"{opening}{self.escape(role)}{named}", closing

    def escape(self, text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        if any(c in text for c in self.controls):
            text = re.sub(f"(?=(?:{'|'.join(map(re.escape, self.controls))}))(.)", r"\1\\", text, flags=re.DOTALL)
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


#: Instruction markup; system first if at all, then user and assistant in turn.
INSTRUCTIONS = Template(
    turns={"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s>", "</s>\n")},
    other=("[ROLE]", "[/ROLE]", "[/TURN]\n"),
    follows={
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    start="start",
    ends=frozenset({"answered"}),
    learned=frozenset({"assistant"}),
)


def _conversation(template: Template, turns: Iterator[tuple[str, str]]) -> Iterator[tuple]:
    """``(turn, role, kind, text, loss, valid, start, end)`` of one conversation."""
    state, at, n = template.start, 0, 0
    for role, text in turns:
        state, valid = template.step(state, role)
        opening, closing = template.marks(role)
        learned = role in template.learned
        for kind, part, loss in (("open", opening, False), ("text", template.escape(text), learned), ("close", closing, False)):
            yield n, role, kind, part, loss, valid, at, at + len(part)
            at += len(part)
        n += 1
    yield n, "", "end", "", False, state in template.ends, at, at


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


_SEGMENT_TYPES = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("kind", pa.string()), ("text", pa.string())]
    + [("loss", pa.bool_()), ("valid", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]
)
_TURN_TYPES = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]
    + [("formatted_chars", pa.int64()), ("valid", pa.bool_())]
)
#: Characters or rows a task gathers before it passes them on.
_BATCH_CHARS, _BATCH_ROWS = 1 << 22, 10_000


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at]) if text_at is not None else 0
        if size >= _BATCH_CHARS or len(held) >= _BATCH_ROWS:
            yield _flush(held, schema)
            held, size = [], 0
    if held:
        yield _flush(held, schema)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Runs of rows with one first field, each streamed (and used up before the next)."""
    return groupby(rows, key=lambda r: r[0])


def segments(rows: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """:data:`SEGMENTS` of conversations given as rows ``conv_id, turn, role, text``.

    Every turn gives an opening, its escaped text and a closing, ``valid`` if
    the state machine accepts its role there; an empty segment of kind ``end``
    closes a conversation, ``valid`` if it may end so. ``loss`` holds for the
    texts of learned roles, valid or not. ``start`` and ``end`` count code
    points of the formatted conversation.

    Turns are ordered by ``turn`` (NULL first), equal ones by role and text;
    repeated rows are turns of their own. NULL roles and texts are empty; rows
    with a NULL conv_id form one conversation. An empty table gives no rows.
    Rows of a conversation come out together and in order.
    """
    chosen = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    dealt = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (t for b in batches for t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()))
        formed = (
            (conv_id, i, *segment)
            for conv_id, run in _runs(turns)
            for i, segment in enumerate(_conversation(template, ((role, text) for _, role, text in run)))
        )
        yield from _in_batches(formed, _SEGMENT_TYPES, 5)

    return dealt.mapInArrow(form, SEGMENTS)


def _parse(template: Template, texts: Iterator[str]) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of a formatted conversation that comes in parts."""
    marks = list(template.turns.items())
    opening, named, closing = template.other
    buffer, longest = "", max(len(o) for o in [opening, *(o for _, (o, _) in marks)])

    def more(until: str, at: int) -> int:
        """Where ``until`` starts, reading on until it is there."""
        nonlocal buffer
        while (found := buffer.find(until, at)) < 0:
            at = max(at, len(buffer) - len(until) + 1)
            buffer += next(texts)
        return found

    while True:
        while len(buffer) < longest and (part := next(texts, None)) is not None:
            buffer += part
        if not buffer:
            return
        role = next((r for r, (o, _) in marks if buffer.startswith(o)), None)
        if role is not None:
            begin, end_mark = len(template.turns[role][0]), template.turns[role][1]
        else:
            if not buffer.startswith(opening):
                raise ValueError("not a formatted conversation")
            name_end = more(named, len(opening))
            role, begin, end_mark = template.unescape(buffer[len(opening) : name_end]), name_end + len(named), closing
        end = more(end_mark, begin)
        yield role, template.unescape(buffer[begin:end])
        buffer = buffer[end + len(end_mark) :]


def read_back(formed: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """:data:`TURNS`: digests of what the formatted text says, one row per conversation.

    Turns are parsed from the segments' texts alone: ``turns_sha256`` is over
    role, line feed, text, line feed of each; ``loss_sha256`` and
    ``loss_chars`` are over the unescaped texts under the loss mask.
    ``formed`` has the rows of a conversation together and in order, as
    :func:`segments` gives them.
    """

    def digest(run: Iterator[tuple]) -> tuple:
        loss, chars, total, valid = hashlib.sha256(), 0, 0, True

        def texts() -> Iterator[str]:
            nonlocal chars, total, valid
            for _, text, learned, accepted in run:
                valid, total = valid and accepted, total + len(text)
                if learned:
                    plain = template.unescape(text)
                    loss.update(plain.encode())
                    chars += len(plain)
                yield text

        turns, n = hashlib.sha256(), 0
        for role, text in _parse(template, texts()):
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
        return n, turns.hexdigest(), chars, loss.hexdigest(), total, valid

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4))))
        yield from _in_batches(((conv_id, *digest(run)) for conv_id, run in _runs(rows)), _TURN_TYPES, None)

    return formed.select("conv_id", "text", "loss", "valid").mapInArrow(read, TURNS)
