import itertools
import re

import numpy as np
import pytest
import xxhash

from crossfade.llm import simhash
from crossfade.llm.components import connected_components


def slow_fingerprint(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows, most):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    name = {fp: {i for i, f in rows if f == fp} for fp in {f for _, f in rows}}
    for a, b in itertools.combinations(list(name), 2):
        if (a ^ b).bit_count() <= most and name[a] is not name[b]:
            joined = name[a] | name[b]
            for fp in [f for f in name if name[f] <= joined]:
                name[fp] = joined
    return {i: min(name[f]) for i, f in rows}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "É x y z w é É", "ab " * 700])
@pytest.mark.parametrize("words", [1, 3, 5])
def test_fingerprint(text, words):
    assert simhash.fingerprint((text or "").encode(), words) == slow_fingerprint(text, words)


def test_long_text_a_piece_at_a_time(monkeypatch):
    text = " ".join(f"word{i * i % 97} Other{i}" for i in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash.pieces, "__defaults__", (100,))
    assert simhash.fingerprint(text.encode()) == whole == slow_fingerprint(text, 3)


def _clustered(seed, centres, each):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(each):
            flips = rng.integers(0, 64, rng.integers(0, 6))
            out.append(int(c) ^ sum(1 << int(b) for b in set(flips)))
    return out


@pytest.mark.parametrize("most", [1, 3, 5])
def test_classes_equal_all_pairs(spark, most):
    marks = _clustered(most, 6, 25) + [0, 0, 7, 2**64 - 1]
    rows = [(i * 3 % len(marks), m) for i, m in enumerate(marks)] if len(marks) % 3 else list(enumerate(marks))
    frame = spark.createDataFrame([(i, m - (1 << 64) if m >> 63 else m) for i, m in rows], "doc_id bigint, fp bigint")
    found = simhash.classes(frame, most).collect()
    assert {r.doc_id: r.component_id for r in found} == slow_classes(rows, most)
    assert len(found) == len(rows)


def test_too_frequent_key_is_cut_again(spark):
    rng = np.random.default_rng(5)
    low = [int(x) for x in rng.integers(0, 2**32, 40, dtype=np.uint64)]
    low += [x ^ (1 << 3) ^ (1 << 17) ^ (1 << 30) for x in low[:10]] + [x ^ 0b1111 for x in low[10:20]]
    rows = [(i, (0xABC << 32) | x) for i, x in enumerate(low)]
    frame = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    found = simhash.classes(frame, 3, limit=32).collect()
    assert {r.doc_id: r.component_id for r in found} == slow_classes(rows, 3)


def test_dense_group_emits_a_forest(spark):
    base = 0x0F0F
    marks = sorted({base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)})
    frame = spark.createDataFrame([(m,) for m in marks], "fp bigint")
    found = simhash.links(frame, 3).count()
    assert found < len(marks) * 12 < len(marks) ** 2 // 2


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a b c d", 1, "x"), (1, "a b c d", 2, "y"), (None, "a b c d", 3, None), (2, None, 4, None), (3, "", 5, None), (None, "only null id here", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp bigint, component_id string")
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(1, 1), (1, 1), (None, 1), (2, 2), (3, 2), (None, None)], key=str)
    kept = simhash.representatives(docs).collect()
    assert len(kept) == 3 and {r.doc_id for r in kept} == {1, 2, None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200), (150, 149), (None, 3)]
    found = connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    got = {r.vertex: r.root for r in found.collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {149: 149, 150: 149}


def test_every_class_keeps_one_row_with_or_without_ids(spark):
    rows = [(1, "a b c d", 1), (1, "a b c d", 2), (None, "a b c d", 3), (None, "only null id here", 4), (None, "only null id here", 4), (7, "a text of its own", 5), (7, "and quite another one of that id", 6)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string, n int"))
    found = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert found == sorted([(1, "a b c d"), (0, "only null id here"), (7, "a text of its own"), (7, "and quite another one of that id")])
    assert simhash.representatives(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_representatives_of_rows_that_are_the_same(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text, 1)] * 5 + [(None, text, 2)] * 3 + [(3, "another text that has nothing to do with it", 1)] * 4 + [(4, None, 1), (5, None, 1), (6, "", 1), (None, "alone", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    for limit in (simhash.MOST_MARKS, 0):
        monkeypatch.setattr(simhash, "MOST_MARKS", limit)
        kept = sorted(((r["doc_id"], r["text"]) for r in simhash.representatives(frame).collect()), key=str)
        assert kept == sorted([(None, text), (3, rows[8][1]), (4, None), (None, "alone")], key=str)


def test_representatives_write_no_texts(spark):
    frame = spark.createDataFrame([(i, f"text {i}" * 50) for i in range(9)], "doc_id bigint, text string")
    written = []
    original = simhash.stage
    try:
        simhash.stage = lambda df, name="t": written.append(df.columns) or original(df, name)
        assert simhash.representatives(frame).count() == 9
    finally:
        simhash.stage = original
    assert written and not any("text" in c for c in written)
