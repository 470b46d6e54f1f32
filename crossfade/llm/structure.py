"""Conversation structure repair over a suffix-shared automaton.

Every conversation has a signature: one symbol per row, for the role it has and
the fault that counts. What the cheapest repair of a conversation does from a
row on depends on the signature's rest and the grammar's state alone, so the
signatures of all conversations are minimised from their ends: rows with one
rest share one node, and the cost to go and the best edit are worked out once
per node and state.

Distinct signatures are sorted by their reversal, which is a walk over the
automaton from its final node: a task holds the nodes of one signature and takes
over all that the next one shares with it. A path that crosses from one task's
range to the next is worked out by both. Edits are read off forwards.

Texts are streamed twice, by conversation and turn: once as digests for the
signatures, once to apply the edits. A task holds one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cmp_to_key
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossfade.sources.staging import stage

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_SPACE = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60
_MOST = (1 << 63) - 1
SIGNED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, signature string"
EDITED = "conv_id bigint, step bigint, edit string, turn bigint, role string, text string"


class Node(NamedTuple):
    """What the best repair does from here on, by state: costs above the least, edits, states, order of the audits."""

    cost: tuple[int, ...]
    edit: tuple[str, ...]
    to: tuple[int, ...]
    rank: tuple[int, ...]


@dataclass(frozen=True)
class Grammar:
    """Which role initials may follow each other, and what edits cost.

    ``follows`` maps a state to the initials accepted in it and the state each
    leads to; a conversation starts in ``start`` and ends in a state of ``ends``.
    ``roles`` may be given to a row or inserted. Costs are positive.
    """

    follows: dict[str, dict[str, str]]
    start: str
    ends: frozenset[str]
    roles: tuple[str, ...]
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    initials: str = field(init=False)

    def __post_init__(self):
        found = "".join(sorted({i for to in self.follows.values() for i in to}))
        if not (found.isascii() and found.isalpha() and found.islower()):
            raise ValueError("initials are lower-case ASCII letters")
        if min(self.rerole, self.delete, self.insert, self.truncated) < 1:
            raise ValueError("costs are positive")
        object.__setattr__(self, "initials", found)


#: A system turn first if at all, then user and assistant in turn; or nothing.
TURNS = Grammar(
    follows={"start": {"s": "told", "u": "asked"}, "told": {"u": "asked"}, "asked": {"a": "answered"}, "answered": {"u": "asked"}},
    start="start",
    ends=frozenset({"start", "answered"}),
    roles=("user", "assistant"),
)


class Solver:
    """The automaton's nodes, from their ends."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self._states = list(grammar.follows)
        number = {s: i for i, s in enumerate(self._states)}
        self._follows = [{i: number[t] for i, t in grammar.follows[s].items()} for s in self._states]
        self.start = number[grammar.start]
        ends = {number[s] for s in grammar.ends}
        self._known: dict[tuple, tuple[int, Node]] = {}
        over = [(0, "", 0, q) if q in ends else (_NEVER, "", 0, q) for q in range(len(self._states))]
        self.end = self._with_insertions(over)

    def before(self, symbol: str, after: Node) -> tuple[int, Node]:
        """``(cost, node)`` of a row ahead of ``after``; equal ones are worked out once."""
        key = (symbol, after.cost, after.rank)
        if key not in self._known:
            self._known[key] = self._with_insertions(self._options(symbol, after))
        return self._known[key]

    def _options(self, symbol: str, after: Node) -> list[tuple[int, str, int, int]]:
        """By state, the best ``(cost, edit, order of the rest, state)`` that uses the row up."""
        g, found = self.grammar, []
        kept = symbol not in "-"
        extra = g.truncated if symbol.isupper() or symbol == "!" else 0
        for q, follows in enumerate(self._follows):
            options = [(g.delete + after.cost[q], "D", after.rank[q], q)]
            if kept and (t := follows.get(symbol.lower())) is not None:
                options.append((extra + after.cost[t], "K", after.rank[t], t))
            if kept:
                for role in g.roles:
                    if (t := follows.get(role[0])) is not None:
                        options.append((g.rerole + extra + after.cost[t], "R", after.rank[t], t))
            found.append(min(options))
        return found

    def _with_insertions(self, direct: list[tuple[int, str, int, int]]) -> tuple[int, Node]:
        """The node whose edits are those of ``direct`` or insertions ahead of them."""
        g, n = self.grammar, len(direct)
        inserted = [[follows[r[0]] for r in g.roles if r[0] in follows] for follows in self._follows]
        cost = [d[0] for d in direct]
        for _ in range(n):  # a cheapest way passes no state twice
            cost = [min([c, *(g.insert + cost[t] for t in inserted[q])]) for q, c in enumerate(cost)]
        chosen: dict[int, tuple[str, int, int]] = {}

        def order(x: tuple[str, int, int], y: tuple[str, int, int]) -> int:
            """Which audit comes first in ASCII, of options that cost the same or not."""
            if x[0] != y[0]:
                return -1 if x[0] < y[0] else 1
            if x[0] == "I":
                return 0 if x[2] == y[2] else order(chosen[x[2]], chosen[y[2]])
            return (x[1] > y[1]) - (x[1] < y[1])

        for q in sorted(range(n), key=lambda q: cost[q]):
            options = [direct[q][1:]] if direct[q][0] == cost[q] else []
            options += [("I", 0, t) for t in inserted[q] if g.insert + cost[t] == cost[q] and t in chosen]
            chosen[q] = min(options, key=cmp_to_key(order)) if options else ("", 0, q)
        in_order = sorted(range(n), key=cmp_to_key(lambda a, b: order(chosen[a], chosen[b])))
        rank, at = [0] * n, 0
        for a, b in zip([None, *in_order], in_order):
            at += a is not None and order(chosen[a], chosen[b]) != 0
            rank[b] = at
        least = min(cost)
        node = Node(tuple(min(c - least, _NEVER) for c in cost), tuple(chosen[q][0] for q in range(n)), tuple(chosen[q][2] for q in range(n)), tuple(rank))
        return least, node

    def audits(self, signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
        """``(signature, cost, audit)`` of signatures sorted by their reversal."""
        rest, nodes, costs = "", [self.end[1]], [self.end[0]]
        for signature in signatures:
            turned = signature[::-1]
            shared = 0
            while shared < min(len(rest), len(turned)) and rest[shared] == turned[shared]:
                shared += 1
            del nodes[shared + 1 :], costs[shared + 1 :]
            for symbol in turned[shared:]:
                more, node = self.before(symbol, nodes[-1])
                nodes.append(node)
                costs.append(costs[-1] + more)
            rest = turned
            yield signature, costs[-1] + nodes[-1].cost[self.start], "".join(self._edits(nodes))

    def _edits(self, nodes: list[Node]) -> Iterator[str]:
        state, at = self.start, len(nodes) - 1
        while edit := nodes[at].edit[state]:
            yield edit
            state = nodes[at].to[state]
            at -= edit != "I"


def _batches(rows: Iterator[tuple], schema: pa.Schema, at: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[at] or "")
        if size >= 1 << 22:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _chosen(rows: DataFrame, present: Column | None) -> DataFrame:
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("mark"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )


def signed(rows: DataFrame, grammar: Grammar = TURNS, present: Column | None = None) -> DataFrame:
    """:data:`SIGNED`: one row per conversation of ``rows`` (``conv_id, turn, role, text``).

    Rows are ordered by ``turn`` (NULL first), those of one turn by role and the
    SHA-256 of their text. NULL roles and texts are one space. A row's first
    fault counts: blank, a duplicate (role and text seen earlier), truncated
    (the last character that isn't white space is none of ``.!?``). ``gaps`` are
    the turns missing between the first and the last (at most 2^63 - 1), and
    ``illegal`` the neighbours whose initials ``grammar`` has nowhere one after
    the other. The symbol of a row is its role's initial (``?`` if the grammar
    doesn't know it), as a capital (``!``) if it is truncated, and ``-`` if it
    has to go. Rows for which ``present`` doesn't hold only name their
    conversation; those with a NULL conv_id are one. An empty table gives none.
    """
    visible = F.rtrim("text", F.lit(_SPACE))
    alone = F.when(visible == "", BLANK).when(~F.right(visible, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    narrow = _chosen(rows, present).select("conv_id", "turn", "role", "mark", alone.alias("alone"), "present").repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "present", "role", "mark").orderBy("turn")
    fault = F.when((F.col("alone") != BLANK) & (F.row_number().over(earlier) > 1), DUPLICATE).otherwise(F.col("alone"))
    narrow = narrow.withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "role", "mark")
    narrow = narrow.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "present")
    pairs = frozenset((i, j) for to in grammar.follows.values() for i, t in to.items() for j in grammar.follows[t])
    types = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("signature", pa.string())])

    def one(run: Iterator[tuple]) -> tuple:
        first = last = before = None
        turns = illegal = 0
        faults, symbols = [0, 0, 0, 0], bytearray()
        for _, turn, initial, fault, there in run:
            if not there:
                continue
            if turn is not None:
                turns += turn != last
                first, last = turn if first is None else first, turn
            illegal += before is not None and (before, initial) not in pairs
            before = initial
            faults[fault] += 1
            known = initial if initial and initial in grammar.initials else "?"
            symbols += ("-" if fault in (BLANK, DUPLICATE) else known if fault == 0 else known.upper().replace("?", "!")).encode()
        gaps = 0 if first is None else min(last - first + 1 - turns, _MOST)
        return gaps, *faults[1:], illegal, symbols.decode()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches(((conv, *one(run)) for conv, run in groupby(found, key=lambda r: r[0])), types, 6)

    return narrow.mapInArrow(compute, SIGNED)


def audits(signatures: DataFrame, grammar: Grammar = TURNS) -> DataFrame:
    """``(signature, cost, audit)``: the cheapest edits of every distinct signature, the ASCII-least of equal ones."""
    types = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    ordered = signatures.select("signature", F.reverse("signature").alias("turned")).distinct().repartitionByRange("turned").sortWithinPartitions("turned")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver(grammar)
        yield from _batches(solver.audits(s for b in batches for s in b.column(0).to_pylist()), types, 2)

    return ordered.select("signature").mapInArrow(compute, "signature string, cost bigint, audit string")


def diagnosed(rows: DataFrame, grammar: Grammar = TURNS, present: Column | None = None) -> DataFrame:
    """:func:`signed` with ``cost`` and ``audit`` of the cheapest repair, as a stage table.

    An audit has the initials of the edits in order: Keep, Rerole, Delete,
    Insert. A blank row or a duplicate is deleted; a truncated row that stays
    costs more. What stays is accepted by ``grammar``.
    """
    found = stage(signed(rows, grammar, present), "structure-signed")
    solved = stage(audits(found, grammar).withColumnRenamed("signature", "solved"), "structure-audits")
    return stage(found.join(solved, F.col("signature") == F.col("solved")).drop("solved"), "structure-diagnosed")


def repaired(rows: DataFrame, found: DataFrame, grammar: Grammar = TURNS, present: Column | None = None) -> DataFrame:
    """:data:`EDITED`: the edits of :func:`diagnosed`, in order, with what they leave.

    Kept and reroled rows have their turn and text, inserted ones an empty text;
    deleted ones have no role and no text. A conversation without any edit is
    one row with a NULL ``step``. Rows of a conversation come out together.
    """
    head = found.select("conv_id", "audit")
    texts = _chosen(rows, present).filter("present")
    both = texts.select("conv_id", F.lit(1).alias("part"), "turn", "role", "mark", "text")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("mark", "binary"))]
    both = both.unionByName(head.select("conv_id", F.lit(0).alias("part"), *empty, F.col("audit").alias("text")))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "mark").select("conv_id", "turn", "role", "text")
    types = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def edited(conv: int | None, run: Iterator[tuple]) -> Iterator[tuple]:
        audit = next(run)[3]
        state = grammar.start
        if not audit:
            yield conv, None, None, None, None, None
        for step, edit in enumerate(audit):
            turn, role, text = next(run)[1:] if edit != "I" else (None, None, "")
            if edit == "D":
                yield conv, step, edit, turn, None, None
                continue
            if edit != "K":  # the grammar leaves one role, as the audit is one of its words
                role = _role(grammar, state, audit, step)
            state = grammar.follows[state][role[0]]
            yield conv, step, edit, turn, role, text

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches((e for conv, run in groupby(all_rows, key=lambda r: r[0]) for e in edited(conv, run)), types, 5)

    return both.mapInArrow(compute, EDITED)


def digests(edited: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of rows of :func:`repaired`: the digest of ``role:text`` of what stays, with line feeds between."""
    types = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def one(run: Iterator[tuple]) -> str:
        found, between = hashlib.sha256(), ""
        for _, role, text in run:
            if role is not None:
                found.update(f"{between}{role}:{text}".encode())
                between = "\n"
        return found.hexdigest()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches(((conv, one(run)) for conv, run in groupby(rows, key=lambda r: r[0])), types, 1)

    return edited.select("conv_id", "role", "text").mapInArrow(compute, "conv_id bigint, repaired_sha256 string")


def _role(grammar: Grammar, state: str, audit: str, step: int) -> str:
    """The role that ``state`` accepts of those that may be given."""
    fits = [r for r in grammar.roles if r[0] in grammar.follows[state]]
    if len(fits) != 1:
        raise ValueError(f"edit {step} of {audit!r} fits {len(fits)} roles in state {state!r}")
    return fits[0]
