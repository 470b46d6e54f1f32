import itertools
import re

import numpy as np
import pytest

from crossfade.llm import resemblance, simhash


def slow_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def coefficient(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_classes(texts, least=0.8):
    """The classes of ``texts`` as sets of their positions, by comparing all pairs."""
    sets = [slow_set(t) for t in texts]
    of = {i: {i} for i in range(len(texts))}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if coefficient(sets[i], sets[j]) >= least and of[i] is not of[j]:
            joined = of[i] | of[j]
            for k in joined:
                of[k] = joined
    return {frozenset(c) for c in of.values()}


def _edited(rng, words, many):
    words = list(words)
    for at in rng.choice(len(words), many, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return words


def planted(seed, groups=12, length=150):
    """Texts with copies that differ in one to twelve words or a block, on both sides of the bound."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{i}" for i in rng.integers(0, 4000, length)]
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base[: int(length * 0.85)]), " ".join(base + base[:3])]
        texts += [" ".join(_edited(rng, base, int(n))) for n in rng.integers(1, 13, 6)]
    return texts


def ids_kept(frame, **options):
    return sorted(r.doc_id for r in resemblance.representatives(frame, **options).collect())


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c d", "a b c d E", "a b c d e f a b c d e f", "É x y z w é É"])
def test_shingle_sets(text):
    found = resemblance.shingle_set((text or "").encode())
    assert len(found) == len(slow_set(text)) and (np.diff(found.astype(object)) > 0).all()
    assert len(resemblance.bands(found)) == (resemblance.BANDS if len(found) else 0)


def test_long_text_a_piece_at_a_time(monkeypatch):
    text = " ".join(f"word{i * i % 97} Other{i}" for i in range(6000)).encode()
    whole = resemblance.shingle_set(text)
    monkeypatch.setattr(resemblance.pieces, "__defaults__", (100,))
    assert (resemblance.shingle_set(text) == whole).all() and len(whole) == len(slow_set(text.decode()))
    keys = resemblance.bands(whole)
    monkeypatch.setattr(resemblance, "_BLOCK", 7)
    assert (resemblance.bands(whole) == keys).all()


def test_bands_meet_as_often_as_they_should():
    rng = np.random.default_rng(2)
    for share, low, high in ((0.8, 0.99, 1.0), (0.3, 0.0, 0.1)):
        both = int(round(300 * 2 * share / (1 + share)))
        met = []
        for _ in range(300):
            mine, ours = rng.integers(0, 1 << 63, (2, 300 - both), dtype=np.uint64), rng.integers(0, 1 << 63, both, dtype=np.uint64)
            met.append((resemblance.bands(np.append(mine[0], ours)) == resemblance.bands(np.append(mine[1], ours))).any())
        assert low <= np.mean(met) <= high


def test_one_of_each_class_as_by_all_pairs(spark):
    texts = planted(4)
    frame = spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    want = slow_classes(texts)
    assert ids_kept(frame) == sorted(min(c) * 7 for c in want) and 12 < len(want) < len(texts) // 2 + 12


def test_exact_bound(spark):
    """Eight of ten shingles in common is enough, seven of ten is not; three bits alone are not either."""
    base = [f"w{i}" for i in range(13)]  # nine shingles
    near, far = [*base[:12], "x"], [*base[:11], "x", "y"]  # 8 of 10, 7 of 11
    assert coefficient(slow_set(" ".join(base)), slow_set(" ".join(near))) == 0.8
    members = [(key, i, 9) for key in (1, 2) for i in range(3)]
    sets = [(i, resemblance.shingle_set(" ".join(w).encode()).view(np.int64).tolist()) for i, w in enumerate((base, near, far))]
    found = resemblance.links(spark.createDataFrame(members, "key bigint, same bigint, size bigint"), spark.createDataFrame(sets, "same bigint, hashes array<bigint>"))
    assert sorted(map(tuple, found.collect())) == [(0, 1)]


def test_members_of_a_key_that_link_through_others(spark):
    """One key holds a chain, whose ends are far from each other, among texts that are near none."""
    words = [f"w{i}" for i in range(400)]
    chain = [words[i * 8 : i * 8 + 200] for i in range(20)]
    alone = [[f"v{j}_{i}" for i in range(200)] for j in range(15)]
    sets = [(i * 4 % 35, resemblance.shingle_set(" ".join(w).encode()).view(np.int64).tolist()) for i, w in enumerate(chain + alone)]
    members = spark.createDataFrame([(9, i, len(s)) for i, s in sets], "key bigint, same bigint, size bigint")
    found = resemblance.links(members, spark.createDataFrame(sets, "same bigint, hashes array<bigint>"))
    got = resemblance.connected_components(found).collect()
    by = dict(sets)
    linked = [{a} for a in by]
    for a, b in itertools.combinations(by, 2):
        if coefficient(set(by[a]), set(by[b])) >= 0.8:
            one, two = (next(c for c in linked if x in c) for x in (a, b))
            if one is not two:
                linked.remove(two)
                one |= two
    assert {r.vertex: r.root for r in got} == {i: min(c) for c in linked if len(c) > 1 for i in c}


def test_large_group_of_near_copies_takes_few_comparisons(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(_edited(rng, base, 1)) if i else " ".join(base)) for i in range(300)]
    written = {}
    original = resemblance.stage
    try:
        resemblance.stage = lambda df, name="t": written.setdefault(name, []).append(original(df, name)) or written[name][-1]
        assert ids_kept(spark.createDataFrame(rows, "doc_id bigint, text string")) == [0]
    finally:
        resemblance.stage = original
    assert sum(p.count() for p in written["resemblance-pairs"]) < 300 * 8
    assert not any("text" in f.columns for frames in written.values() for f in frames)


def test_nulls_repeats_ties_and_clashing_names(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, "a b c d", 1, "x"), (1, "A b c d", 2, "y"), (None, "a b  c d", 3, None), (2, None, 4, None), (3, " ", 5, None), (None, "only null id here", 6, None)]
    rows += [(None, long, 1, "z")] * 4 + [(8, "b c d e", 7, None), (8, "c d e f", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, same bigint, size string")
    found = resemblance.representatives(docs)
    assert found.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    first = next(t for i, t in kept if i == 1)
    assert first in ("a b c d", "A b c d")
    assert kept == sorted([(1, first), (2, None), (None, "only null id here"), (None, long), (8, "b c d e"), (8, "c d e f")], key=str)
    assert resemblance.representatives(docs.limit(0)).count() == 0


def test_many_marks_are_joined_alike(spark, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(planted(6, groups=3))), "doc_id bigint, text string")
    want = ids_kept(frame)
    monkeypatch.setattr(simhash, "MOST_MARKS", 0)
    monkeypatch.setattr(resemblance, "_BATCH", 100)
    assert ids_kept(frame) == want


@pytest.mark.parametrize("text", ["", " ", "One", "a b c d E", "a b c d e f a b c d e f", " ".join(f"w{i % 90}" for i in range(700))])
def test_one_pass_measures_as_two(text, monkeypatch):
    monkeypatch.setattr(resemblance.pieces, "__defaults__", (100,))
    found, mark = resemblance.measured(text.encode())
    assert (found == resemblance.shingle_set(text.encode())).all() and mark == simhash.fingerprint(text.encode(), 5)


def test_bitmaps_rule_out_no_link(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 40, 300)]
    for base in sets[1:]:
        for part in (0.3, 0.6, 0.79, 0.8, 0.9):
            sets.append(np.unique(np.append(base[: int(np.ceil(len(base) * part))], rng.integers(0, 1 << 63, 2, dtype=np.uint64))))
        sets.append(np.unique(np.append(base[: len(base) // 2], rng.integers(0, 1 << 63, len(base) - len(base) // 2, dtype=np.uint64))))
    rows = [(i, len(s), resemblance.bitmap(s).view(np.int64).tolist(), s.view(np.int64).tolist()) for i, s in enumerate(sets)]
    pairs = list(itertools.combinations(range(1, len(sets)), 2))
    frame = spark.createDataFrame(rows, resemblance._SETS)
    left = {(r.a, r.b) for r in resemblance._possible(spark.createDataFrame(pairs, "a bigint, b bigint"), frame, 0.8).collect()}
    linked = {(a, b) for a, b in pairs if coefficient(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8}
    assert linked and linked <= left
    alike = lambda a, b: len(rows[a][2]) == len(rows[b][2]) and min(len(sets[a]), len(sets[b])) >= 40
    far = {(a, b) for a, b in pairs if alike(a, b) and coefficient(set(sets[a].tolist()), set(sets[b].tolist())) < 0.5}
    assert far and not far & left


def test_group_below_the_bound_makes_few_pairs(spark):
    """Copies of one text that link to it or to nobody: three quarters are beyond the bound of each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)] + [" ".join(_edited(rng, base, int(n))) for n in rng.integers(1, 11, 400)]
    written = {}
    original = resemblance.stage
    try:
        resemblance.stage = lambda df, name="t": written.setdefault(name, []).append(original(df, name)) or written[name][-1]
        found = ids_kept(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4))
    finally:
        resemblance.stage = original
    want = slow_classes(texts)
    assert found == sorted(map(min, want)) and 200 < len(want) < 350
    assert sum(p.count() for p in written["resemblance-pairs"]) < len(texts) * 16


def test_sets_that_others_share_nothing_more_of(spark):
    """What counts is held by another component; a set stays if that may reach the bound with a size of its key."""
    sets = {1: range(10), 2: [*range(9), 90], 3: [*range(6), 91, 92, 93, 94], 4: range(200, 210), 5: range(200, 210)}
    members = [(7, i, len(s), min(i, 4)) for i, s in sets.items()]
    frame = spark.createDataFrame(members, "key bigint, same bigint, size bigint, comp bigint")
    hashes = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "same bigint, hashes array<bigint>")
    found = resemblance._linkable(frame, hashes, 0.8)
    assert sorted((r.same, r.most) for r in found.collect()) == [(1, 9), (2, 9)]
    assert sorted(r.same for r in resemblance._led(frame).collect()) == [1, 2, 3]
