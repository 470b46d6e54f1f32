"""Near-duplicates by the Jaccard coefficient of word shingles, with SimHash classes among the candidates.

Three of 64 bits reach close copies only: two texts whose five-word shingles have
a coefficient of 0.8 differ in about ten bits, more than segments with one bit
deleted can index. So texts meet in two ways, and every meeting is verified by
the exact coefficient of the two sets of shingles:

* in the class of :mod:`crossfade.llm.simhash`, and
* in bands of minimum hashes of the same shingles: two texts at 0.8 share one of
  26 bands of six with a probability of 0.9996, and more often the nearer they are.

Texts with equal sets are one vertex, however many rows hold them. A key's members
are compared with leaders drawn from them, never pair by pair: in round ``r`` each
key has up to ``4 ** r`` new leaders, and only members of other components than
the leader's are compared. Leaders are those that share their keys with most
others, so what a group was copied from leads first. Bitmaps of two sets bound
their coefficient from above; the sets themselves are joined for the pairs left by
that. A key is done when its members are of one component, or those outside its
largest one have all been leaders, so no link that a key holds is lost, and a large
group of copies is done after a few rounds of as many comparisons as it has members.

A group may also hold many texts that are alike but below the bound. After the
second round a hash counts for a set only if a set of another component holds it
too, among those still open. What counts bounds the coefficient with any of them:
members that reach the bound with nobody go without being compared. Bitmaps are
then compared where members meet, so that no row is made for a pair that they rule
out. Of members that none of this tells apart each still meets each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfade.llm import simhash
from crossfade.llm.components import connected_components
from crossfade.llm.text import byte_texts, pieces
from crossfade.sources.staging import stage

BANDS, ROWS = 26, 6
#: Shingle hashes taken through all minimum hashes at once, and handed on in one batch of sets.
_BLOCK, _BATCH = 1 << 8, 1 << 20
#: Bits of a set's bitmap for each of its hashes, at least.
_SPREAD = 4
_MIX = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_FACTOR, _SHIFT = _MIX[0] * np.uint64(2) + np.uint64(1), _MIX[1]


def shingles(text: bytes, words: int = 5) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of one text, a piece at a time; a shorter text is one shingle, a blank one none."""
    carry, some = [], False
    for piece in pieces(text):
        found = carry + piece.lower().split()
        if len(found) >= words:
            some = True
            spoken = map(b" ".join, zip(*(found[i:] for i in range(words))))
            yield np.fromiter((xxhash.xxh64_intdigest(s, simhash.SEED) for s in spoken), dtype=np.uint64)
            found = found[len(found) - words + 1 :]
        carry = found
    if carry and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), simhash.SEED)], dtype=np.uint64)


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct hashes of :func:`shingles`, sorted."""
    found = [np.unique(h) for h in shingles(text, words)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def measured(text: bytes, words: int = 5) -> tuple[np.ndarray, int]:
    """:func:`shingle_set` and, of the same hashes, :func:`simhash.fingerprint`."""
    counts, total, found = np.zeros(simhash.BITS, dtype=np.int64), 0, []
    for hashes in shingles(text, words):
        counts += simhash._bit_counts(hashes)
        total += len(hashes)
        found.append(np.unique(hashes))
    if not total:
        return np.zeros(0, dtype=np.uint64), 0
    return np.unique(np.concatenate(found)), int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A power of two of bits, with those set that the low ends of the hashes name, as words of 64."""
    bits = max(64, 1 << (_SPREAD * len(hashes) - 1).bit_length()) if len(hashes) else 64
    marks = np.zeros(bits, dtype=bool)
    marks[hashes & np.uint64(bits - 1)] = True
    return np.packbits(marks, bitorder="little").view(np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key per band of minimum hashes of a set; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(least, (hashes[at : at + _BLOCK, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], dtype=np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sketch(words: int):
    """Task: every row's SimHash, its set as one number, the set's size and its bands."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, size, fp, keys = [], [], [], []
            for text in byte_texts(batch.column(3)):
                found, mark = measured(text, words)
                same.append(xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else 0)
                size.append(len(found))
                fp.append(mark)
                keys.append(bands(found))
            whole = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (same, size, fp)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *whole, _lists(keys)], ["own", "__mark", "__more", "same", "size", "fp", "bands"])

    return compute


_SETS = "same bigint, size int, bits array<bigint>, hashes array<bigint>"


def _sets(words: int):
    """Task: every row's set of shingles and its bitmap, a bounded number of hashes a batch."""

    def batch_of(same: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(same, pa.int64()), pa.array(list(map(len, held)), pa.int32()), _lists(list(map(bitmap, held))), _lists(held)]
        return pa.RecordBatch.from_arrays(columns, ["same", "size", "bits", "hashes"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, held, many = [], [], 0
            for mark, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                same.append(mark)
                held.append(shingle_set(text, words))
                many += len(held[-1])
                if many >= _BATCH:
                    yield batch_of(same, held)
                    same, held, many = [], [], 0
            if same:
                yield batch_of(same, held)

    return compute


def _lacking(x: str, y: str):
    """How many bits of the bitmap ``x`` are not in ``y``."""
    ones = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
    return F.aggregate(ones, F.lit(0), lambda total, n: total + n)


def _may_reach(least: float, size_a: str, bits_a: str, size_b: str, bits_b: str):
    """Whether two sets may reach ``least``: a bit that one bitmap alone has is a hash that the other set lacks.

    Bitmaps of two lengths say nothing.
    """
    most = F.least(F.col(size_a) - _lacking(bits_a, bits_b), F.col(size_b) - _lacking(bits_b, bits_a))
    bounded = most / (F.col(size_a) + F.col(size_b) - most) >= least
    return (F.size(bits_a) != F.size(bits_b)) | bounded


def _possible(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs that may reach ``least`` by their bitmaps."""
    outlines = sets.select("same", "size", "bits")
    left = outlines.withColumnsRenamed({"same": "a", "size": "size_a", "bits": "bits_a"})
    right = outlines.withColumnsRenamed({"same": "b", "size": "size_b", "bits": "bits_b"})
    both = pairs.join(right, "b").join(left, "a")
    return both.filter(_may_reach(least, "size_a", "bits_a", "size_b", "bits_b")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets have a coefficient of ``least`` or more."""
    if "bits" in sets.columns:
        pairs = stage(_possible(pairs, sets, least), "resemblance-possible")
    asked = simhash._bounded(pairs.select(F.col("a").alias("same")).unionByName(pairs.select(F.col("b").alias("same"))).distinct())
    sets = sets.select("same", "hashes").join(asked, "same", "left_semi")  # the others are not shuffled again in every round
    left = sets.select(F.col("same").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("same").alias("b"), F.col("hashes").alias("of_b"))
    both = pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    every = F.size("of_a") + F.size("of_b") - F.col("common")
    return both.filter(F.col("common") / every >= least).select("a", "b")


def _roots(links: DataFrame) -> DataFrame:
    """``(same, comp)``: the least vertex that ``links`` reach from each of theirs."""
    return stage(connected_components(links).withColumnsRenamed({"vertex": "same", "root": "comp"}), "resemblance-roots")


def _components(roots: DataFrame | None, members: DataFrame) -> DataFrame:
    """``members`` with ``comp``, themselves where they have no link."""
    if roots is None:
        return members.withColumn("comp", F.col("same"))
    return members.join(roots, "same", "left").withColumn("comp", F.coalesce("comp", "same"))


def _open(members: DataFrame) -> DataFrame:
    """Members of keys that hold more than one component."""
    keys = members.groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last"))
    return members.join(keys.filter(F.col("first") != F.col("last")).select("key"), "key", "left_semi")


def _weighed(members: DataFrame) -> DataFrame:
    """``members`` with ``weight``: how many members their set meets in all its keys."""
    many = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weights = members.select("key", "same").join(many, "key").groupBy("same").agg(F.sum("n").alias("weight"))
    return members.join(weights, "same")


def _linkable(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``members`` with ``most``, without those that reach ``least`` with no other component of their key.

    ``most`` counts a set's hashes that sets of other components hold as well:
    it has no more in common with any of them. Of ``x`` and ``y`` hashes,
    ``least`` takes ``least / (1 + least) * (x + y)`` in common, and ``y`` is at
    least the smallest size in the key, and ``least * x``.
    """
    open_sets = stage(members.select("same", "comp").distinct(), "resemblance-open")
    held = sets.select("same", "hashes").join(open_sets, "same").select("same", "comp", F.explode("hashes").alias("hash"))
    spread = held.groupBy("hash").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).filter(F.col("first") != F.col("last"))
    spread = stage(spread.select("hash"), "resemblance-spread")
    most = stage(held.join(spread, "hash", "left_semi").groupBy("same").agg(F.count(F.lit(1)).cast("int").alias("most")), "resemblance-most")
    smallest = members.groupBy("key").agg(F.min("size").alias("smallest"))
    both = members.join(most, "same").join(smallest, "key")
    reach = F.col("most") * ((1 + least) / least) - F.col("size") + 1e-6
    return both.filter(reach >= F.greatest("smallest", F.col("size") * least)).drop("smallest")


def _led(members: DataFrame) -> DataFrame:
    """The members outside the largest component of their key; they meet all that is to be compared."""
    parts = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m")).select("key", F.col("m.comp").alias("largest"))
    return members.join(largest, "key").filter(F.col("comp") != F.col("largest"))


def _narrowed(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """What is open of :func:`_linkable` members, with the bitmaps of their sets."""
    rest = _open(stage(_linkable(members, sets, least), "resemblance-linkable"))
    return rest.join(sets.select("same", "bits"), "same") if "bits" in sets.columns else rest


def links(members: DataFrame, sets: DataFrame, least: float = 0.8) -> DataFrame | None:
    """``(a, b)``: verified links that connect all that keys bring together; None if there are none.

    ``members`` has a row ``(key, same, size)`` for each key of each set, and
    ``sets`` the ``hashes`` of each ``same`` that shares a key, and maybe their
    ``size`` and :func:`bitmap` ``bits``.
    """
    found, roots, tried, turn = None, None, None, 0
    left = stage(_open(_components(None, _weighed(members))), "resemblance-members")
    while not left.isEmpty():
        lots = F.pmod(F.xxhash64("same", F.lit(turn)), F.lit(1 << min(2 * turn, 20)))
        told = [c for c in ("same", "size", "comp", "most", "bits") if c in left.columns]
        leaders = (left if turn < 2 else _led(left)).groupBy("key", lots.alias("lot")).agg(F.max_by(F.struct(*told), F.struct("weight", "same")).alias("l"))
        leaders = stage(leaders.select("key", "l.*"), "resemblance-leaders")
        led = leaders.withColumnsRenamed({c: f"l_{c}" for c in told})
        near = F.least("size", "l_size") / F.greatest("size", "l_size") >= least
        if "most" in told:
            most = F.least("most", "l_most")
            near &= most / (F.col("size") + F.col("l_size") - most) >= least
        if "bits" in told:
            near &= _may_reach(least, "size", "bits", "l_size", "l_bits")
        met = left.join(led, "key").filter((F.col("comp") != F.col("l_comp")) & near)
        pairs = met.select(F.least("same", "l_same").alias("a"), F.greatest("same", "l_same").alias("b")).distinct()
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "resemblance-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = stage(_verified(pairs, sets, least), "resemblance-links")
        if not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            roots = _roots(found)
        rest = left.join(leaders.select("key", "same"), ["key", "same"], "left_anti").drop("comp")
        left, turn = stage(_open(_components(roots, rest)), "resemblance-members"), turn + 1
        if turn == 2 and not left.isEmpty():
            left = stage(_narrowed(left, sets, least), "resemblance-members")
    return found


def representatives(docs: DataFrame, words: int = 5, least: float = 0.8, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of texts linked at a coefficient of ``least`` or more.

    Shingles are ``words`` words as in :func:`simhash.fingerprints`, each counted
    once; a shorter text is one shingle. NULL and blank texts have none and are
    one class. Which row stays, and what holds for NULL ids, repeated rows, clashing
    names and empty tables, is said in :func:`simhash.representatives`. Sets are told
    apart by 64 bits. No text is written; sets of hashes are, of texts that share a key.
    """
    own = F.col(id_col).cast("bigint").alias("own")
    text = F.col(text_col).cast("string").alias("text")
    schema = "own bigint, __mark bigint, __more int, same bigint, size bigint, fp bigint, bands array<bigint>"
    drawn = stage(docs.select(own, *simhash._marks(docs), text).mapInArrow(_sketch(words), schema), "resemblance-sketches")
    rows = stage(drawn.groupBy("same", "own", "__mark", "__more").agg(F.count(F.lit(1)).alias("n")), "resemblance-rows")
    first = F.min(simhash.first_row()).alias("first")
    distinct = drawn.groupBy("same").agg(first, F.any_value(F.struct("size", "fp", "bands")).alias("s"))
    distinct = stage(distinct.select("same", "first", "s.size", "s.fp", "s.bands"), "resemblance-distinct")
    alike = connected_components(simhash.links(distinct.select("fp").distinct(), most)).withColumnsRenamed({"vertex": "fp"})
    filled = distinct.filter(F.col("size") > 0)
    by_print = filled.select("same", "size", "fp").join(alike, "fp", "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"), "same", "size")
    by_band = filled.select(F.explode("bands").alias("key"), "same", "size")
    every = by_print.unionByName(by_band)
    shared = stage(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("key"), "resemblance-shared")
    members = stage(every.join(simhash._bounded(shared), "key", "left_semi"), "resemblance-keys")
    asked = distinct.join(members.select("same").distinct(), "same", "left_semi").select("first.__mark", "first.__more", "same")
    again = rows.filter(F.col("n") > 1).select("__mark", "__more", F.lit(True).alias("again")).distinct()
    asked = stage(asked.join(again, ["__mark", "__more"], "left").withColumn("again", F.coalesce("again", F.lit(False))), "resemblance-asked")
    marked = docs.select(*simhash._marks(docs), text)
    texts = marked.join(simhash._bounded(asked.filter(~F.col("again"))), ["__mark", "__more"]).select("same", "text")
    repeated = asked.filter("again")
    if not repeated.isEmpty():
        copies = marked.join(simhash._bounded(repeated), ["__mark", "__more"])
        texts = texts.unionByName(copies.groupBy("same").agg(F.any_value("text").alias("text")))
    sets = stage(texts.mapInArrow(_sets(words), _SETS), "resemblance-sets")
    found = links(members, sets, least)
    grouped = stage(_components(None if found is None else _roots(found), distinct.select("same", "first")).withColumnRenamed("comp", "class"), "resemblance-classes")
    return simhash.kept(docs, rows, grouped)
