"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. For links at ``k`` or fewer differing bits it is cut
into ``k // 2 + 1`` segments, fewer than the ``k + 1`` that an exact match would
take, so that one segment of two linked fingerprints differs by at most one
bit. The index holds each segment as it is and with each one of its bits
deleted; rows with equal index keys meet, and every meeting is verified over
all 64 bits.

* Equal fingerprints are one entry of the index, however many documents hold it.
* The index is shuffled and sorted by key once; a task sees the members of a
  key in a row. From a key's members it emits a spanning forest of the verified
  links, never all pairs, so links grow with members and not with their square.
* A key with more than ``KEY_LIMIT`` members is not held in memory: its members
  are cut again in the bits the key leaves open, which is as exact, until the
  open bits bound the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfade.llm.components import connected_components
from crossfade.llm.text import byte_texts, pieces
from crossfade.sources.staging import stage

BITS = 64
SEED = 42
#: Members of one key compared in memory; more are cut again. Any value gives the same links.
KEY_LIMIT = 1 << 14
_LANES = np.uint64(0x0101010101010101)
_FOUND = "key bigint, open bigint, bit int, a bigint, b bigint"


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: eight byte-wide counters per word, 255 rows at a time."""
    starts = np.arange(0, len(hashes), 255)
    counts = np.empty((8, 8), dtype=np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, starts)
        counts[:, shift] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(-1)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of one text as an unsigned number; zero without words."""
    counts, total, carry = np.zeros(BITS, dtype=np.int64), 0, []
    for piece in pieces(text):
        found = carry + piece.lower().split()
        if len(found) >= words:
            shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
            hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
            counts += _bit_counts(hashes)
            total += len(hashes)
            found = found[len(found) - words + 1 :]
        carry = found
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: one signed 64-bit SimHash per row of ``docs``.

    Words are runs of other than space, tab, line feed, vertical tab, form feed
    and carriage return, with A-Z lower-cased; shingles are ``words`` of them,
    repeats included; a shorter text is one shingle. NULL and blank texts have
    fingerprint zero. Whole texts count, a piece at a time.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t, words) for t in byte_texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(compute, "doc_id bigint, fp bigint")


def _segments(bits: list[int], most: int) -> list[list[int]]:
    """The bits cut into the fewest segments of which one must differ by one bit at most."""
    return [list(map(int, s)) for s in np.array_split(np.array(bits), most // 2 + 1)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def signatures(marks: DataFrame, most: int) -> DataFrame:
    """``(key, open, bit, fp)``: the index rows of distinct fingerprints.

    One row per segment and one per deleted bit; ``bit`` is the deleted one or
    -1. ``open`` is the mask of the bits that the key says nothing of.
    """
    variants = [
        (deleted, _mask(segment) & ~(1 << deleted if deleted >= 0 else 0))
        for segment in _segments(list(range(BITS)), most)
        for deleted in [-1, *segment]
    ]
    table = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(_signed(kept)).alias("kept")) for bit, kept in variants))
    variant = marks.select("fp", F.posexplode(table).alias("variant", "v"))
    return variant.select(
        F.xxhash64("variant", F.col("fp").bitwiseAND(F.col("v.kept"))).alias("key"),
        F.bitwise_not("v.kept").alias("open"),
        F.col("v.bit").alias("bit"),
        "fp",
    )


class _Members:
    """Members of one key, how they meet, and how they are cut again if they are too many."""

    def __init__(self, key: int, opened: int, bit: int, most: int, limit: int):
        self.key, self.open, self.bit, self.most = key, opened & (1 << BITS) - 1, bit, most
        # distinct members differ in open bits only, so these bound their number
        self.limit = None if 1 << self.open.bit_count() <= limit else limit

    def across(self, difference: np.ndarray) -> np.ndarray:
        """Verified links; those that agree in the deleted bit meet under the undeleted key as well."""
        near = np.bitwise_count(difference) <= self.most
        return near if self.bit < 0 else near & (difference >> np.uint64(self.bit) & np.uint64(1)).astype(bool)

    def forest(self, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links that connect what links of ``most`` or fewer bits connect."""
        rest = members
        while len(rest):
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                here = frontier.pop()
                near = np.bitwise_count(rest ^ here) <= self.most
                if near.any():
                    found, rest = rest[near], rest[~near]
                    frontier.extend(found)
                    found = found[self.across(found ^ here)]
                    if len(found):
                        yield np.full(len(found), here), found

    def cut_again(self, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Index rows of the members in the open bits."""
        bits = [b for b in range(BITS) if self.open >> b & 1]
        for s, segment in enumerate(_segments(bits, self.most)):
            for deleted in [-1, *segment]:
                kept = _mask(segment) & ~(1 << deleted if deleted >= 0 else 0)
                salt = np.uint64(xxhash.xxh64_intdigest(repr((self.key, s, deleted)).encode()))
                mixed = ((members & np.uint64(kept)) ^ salt) * np.uint64(0x9E3779B97F4A7C15)
                key = (mixed ^ (mixed >> np.uint64(29))).view(np.int64)
                n = len(members)
                yield _rows(key, np.full(n, _signed(self.open & ~kept)), np.full(n, deleted, np.int32), members, None)

    def settle(self, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.limit and len(members) > self.limit:
            yield from self.cut_again(members)
        elif len(members) > 1 and (found := list(self.forest(members))):
            yield _rows(None, None, None, *(np.concatenate(side) for side in zip(*found)))


def _rows(key, opened, bit, a, b) -> pa.RecordBatch:
    columns = [(key, pa.int64()), (opened, pa.int64()), (bit, pa.int32()), (a.view(np.int64), pa.int64()), (b, pa.int64())]
    arrays = [pa.nulls(len(a), t) if c is None else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, t) for c, t in columns]
    return pa.RecordBatch.from_arrays(arrays, ["key", "open", "bit", "a", "b"])


def _meet(most: int, limit: int):
    """Task over index rows sorted by key: verified links, and index rows of keys beyond ``limit``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, flowing = None, [], False  # the run that the next batch may go on with
        for batch in batches:
            keys, opened, bits, fps = (batch.column(i).to_numpy() for i in range(4))
            if not len(keys):
                continue
            fps = fps.view(np.uint64)
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (opened[1:] != opened[:-1])) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(keys))
            first, last = 0, len(starts) - 1
            if run is not None and keys[0] == run.key and opened[0] == _signed(run.open):
                held.append(fps[: ends[0]].copy())
                first = 1
            if first <= last:  # whatever was held is over, and the last run of this batch is held
                if run is not None:
                    yield from (run.cut_again if flowing else run.settle)(np.concatenate(held or [fps[:0]]))
                inner = slice(first, last)
                sizes = ends[inner] - starts[inner]
                pairs = starts[inner][sizes == 2]
                if len(pairs):
                    a, b, bit = fps[pairs], fps[pairs + 1], bits[pairs]
                    difference = a ^ b
                    near = np.bitwise_count(difference) <= most
                    near &= (bit < 0) | (difference >> np.maximum(bit, 0).astype(np.uint64) & np.uint64(1)).astype(bool)
                    if near.any():
                        yield _rows(None, None, None, a[near], b[near])
                for i in np.flatnonzero(sizes > 2) + first:
                    at = starts[i]
                    whole = _Members(int(keys[at]), int(opened[at]), int(bits[at]), most, limit)
                    yield from whole.settle(fps[at : ends[i]])
                at = starts[last]
                run = _Members(int(keys[at]), int(opened[at]), int(bits[at]), most, limit)
                held, flowing = [fps[at:].copy()], False
            if run.limit and sum(map(len, held)) > run.limit:  # passed on as it comes
                flowing = True
                yield from run.cut_again(np.concatenate(held))
                held = []
        if run is not None and held:
            yield from (run.cut_again if flowing else run.settle)(np.concatenate(held))

    return compute


def links(marks: DataFrame, most: int = 3, limit: int = KEY_LIMIT) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that connect all those of ``most`` or fewer bits.

    ``marks`` has one row per distinct ``fp``. The links are a spanning forest
    of each index key, so two fingerprints that differ by ``most`` bits are
    linked directly or through others that are.
    """
    found, index = None, signatures(marks, most)
    while True:
        dealt = index.repartition("key").sortWithinPartitions("key", "open")
        step = stage(dealt.mapInArrow(_meet(most, limit), _FOUND), "simhash-links")
        pairs = step.filter(F.col("key").isNull()).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        left = step.filter(F.col("key").isNotNull()).select("key", "open", "bit", F.col("a").alias("fp"))
        if left.isEmpty():
            return found.distinct()
        index = left


def classes(marks: DataFrame, most: int = 3, limit: int = KEY_LIMIT) -> DataFrame:
    """``(doc_id, fp, component_id)`` for rows of :func:`fingerprints`.

    ``component_id`` is the smallest doc_id that links of ``most`` or fewer
    differing bits reach, the document itself included; equal fingerprints are
    linked. A NULL doc_id gets its class and never names one; a class of NULL
    ids alone has a NULL name. Repeated rows stay.
    """
    marks = stage(marks, "simhash-marks")
    distinct = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = stage(connected_components(links(distinct.select("fp"), most, limit)), "simhash-roots")
    named = distinct.join(roots, F.col("fp") == F.col("vertex"), "left")
    named = named.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    name = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(name, "root").select("fp", "component_id")
    return marks.join(stage(named, "simhash-names"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``; see :func:`fingerprints` and :func:`classes`.

    An empty table gives an empty result.
    """
    return classes(fingerprints(docs, words, id_col, text_col), most)


def hexadecimal(fp: str = "fp"):
    """A signed fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Rows to leave out whose marks are broadcast; more are joined as the planner likes.
MOST_MARKS = 1 << 20


def _marks(docs: DataFrame) -> list:
    """Two hashes of all columns, which stand for a row: 96 bits."""
    return [F.xxhash64(*docs.columns).alias("__mark"), F.hash(*docs.columns).alias("__more")]


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= MOST_MARKS else keys


def first_row():
    """What is least in the row of a class that stays."""
    return F.struct(F.col("own").isNull().alias("unnamed"), "own", "__mark", "__more")


def kept(docs: DataFrame, rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``class`` of ``grouped``, which has its least ``first`` by parts of it.

    ``rows`` are the rows of ``docs`` by their marks, ``n`` of each.
    """
    chosen = stage(grouped.groupBy("class").agg(F.min("first").alias("first")).select("first.__mark", "first.__more"), "simhash-chosen")
    # those that stay are known by their marks alone: a row's class follows from its columns
    others = rows.join(chosen, ["__mark", "__more"], "left_anti").select("__mark", "__more").distinct()
    again = rows.filter(F.col("n") > 1).join(chosen, ["__mark", "__more"], "left_semi").select("__mark", "__more")
    gone = stage(others.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True))), "simhash-gone")
    marked = docs.select("*", *_marks(docs))
    stay = marked.join(_bounded(gone.drop("again")), ["__mark", "__more"], "left_anti").select(*docs.columns)
    one = marked.join(_bounded(gone.filter("again").drop("again")), ["__mark", "__more"], "left_semi").groupBy("__mark", "__more")
    return stay.unionByName(one.agg(*(F.any_value(c).alias(c) for c in docs.columns)).select(*docs.columns))


def representatives(docs: DataFrame, words: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of :func:`classes`, with or without ids.

    It is that with the smallest doc_id, NULL after all others; among rows of
    one doc_id the hash of their columns decides. Rows with one doc_id but texts
    of different classes stay, one for each class. An empty table gives none.

    Rows are known by hashes of their columns, so what is written and grouped is
    narrow; ``docs`` is read again without the rows that go. Rows that are the
    same in all columns and stay in their class go as well, and one of each comes
    back.
    """
    own = F.col(id_col).cast("bigint").alias("own")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in byte_texts(batch.column(3))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))], ["own", "__mark", "__more", "fp"])

    named = docs.select(own, *_marks(docs), F.col(text_col).cast("string").alias("text"))
    rows = named.mapInArrow(compute, "own bigint, __mark bigint, __more int, fp bigint")
    rows = stage(rows.groupBy("fp", "own", "__mark", "__more").agg(F.count(F.lit(1)).alias("n")), "simhash-rows")
    distinct = stage(rows.groupBy("fp").agg(F.min(first_row()).alias("first")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), most)).withColumnsRenamed({"vertex": "fp", "root": "class"})
    grouped = stage(distinct.join(roots, "fp", "left").withColumn("class", F.coalesce("class", "fp")), "simhash-classes")
    return kept(docs, rows, grouped)
