import hashlib
import itertools
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from crossfade.llm import queries, zonemap


@pytest.mark.parametrize("axes,bits", [(2, 1), (2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve_meets_every_cell_once_and_steps_to_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    places = zonemap.hilbert(cells, bits)
    assert sorted(places.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(places)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@given(arrays(np.int64, (7, 3), elements=st.integers(-9, 9)), arrays(np.int64, (5, 3), elements=st.integers(-9, 9)))
def test_every_nearest_centroid_is_a_candidate_of_its_box(x, centroids):
    near = zonemap.candidates(x.min(axis=0), x.max(axis=0), centroids)
    distance = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert set(distance.argmin(axis=1)) <= set(near)
    best, least = zonemap.compare(x, centroids[near])
    assert (near[best] == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()


def test_a_far_box_has_one_candidate():
    centroids = np.array([[0, 0], [1000, 1000], [5000, 0]])
    assert zonemap.candidates(np.array([990, 990]), np.array([1010, 1005]), centroids).tolist() == [1]


def test_comparison_is_exact_beyond_doubles():
    m = zonemap.LARGEST
    x = np.array([[m] * 64, [-m] * 64])
    centroids = np.array([[-m] * 64, [-m] * 63 + [-m + 1], [m] * 63 + [m - 1]])
    best, distance = zonemap.compare(x, centroids)
    assert best.tolist() == [2, 0] and distance.tolist() == [1, 0]
    assert zonemap.compare(x[:1], centroids[:1])[1][0] == 64 * (2 * m) ** 2


def plain(rows, k, rounds, salt, width):
    """Python integers only."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"{salt}:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [x for _, x in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = {}
        for _, x in kept:
            of.setdefault(nearest(x)[1], []).append(x)
        for n, members in of.items():
            centroids[n] = [sum(column) // len(members) for column in zip(*members)]
    return centroids, sorted(((i, *nearest(x)[::-1]) for i, x in kept), key=str)


def test_same_as_plain_integers(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 4))
    rows = [(i, [float(c) for c in np.float32(middles[i % 6] + 0.1 * rng.normal(size=4))]) for i in range(600)]
    rows += [(i, [0.5, -0.5, 0.25, 0.0]) for i in range(600, 900)]  # a third of all rows are one vector
    rows += [(901, None), (902, [1.0, 2.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [1.0, None, 0.0, 0.0]), (905, [1.0, float("inf"), 0.0, 0.0])]
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label string, cluster int")
    found, centroids = zonemap.clusters(df, k=9, rounds=4, salt="t", components=4, block_rows=32)
    want, assigned = plain(rows, 9, 4, "t", 4)
    assert centroids.tolist() == want
    assert sorted((tuple(r) for r in found.collect()), key=str) == assigned
    summary = zonemap.summarised(found, centroids).collect()
    total = sum(d for _, _, d in assigned)
    for r in summary:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for _, c, d in assigned if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want[r["cluster"]])).encode()).hexdigest()


def test_blocks_are_narrow_and_prune(spark):
    rng = np.random.default_rng(6)
    middles = 10 * rng.normal(size=(8, 16))
    rows = [(i, [float(c) for c in middles[i % 8] + 0.05 * rng.normal(size=16)]) for i in range(2000)]
    ints = zonemap.integers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 16)
    whole = zonemap.blocks(ints, 16, block_rows=50).collect()
    assert sorted(i for b in whole for i in b["ids"]) == list(range(2000))
    centroids = np.floor(256 * middles).astype(np.int64)
    counts = [len(zonemap.candidates(*(np.frombuffer(bytes(b[c]), np.int64) for c in ("low", "high")), centroids)) for b in whole]
    assert np.mean(counts) < 2


def test_empty_table_few_vectors_and_huge_components(spark):
    schema = "vec_id bigint, embedding array<double>"
    found, centroids = zonemap.clusters(spark.createDataFrame([], schema), components=2)
    assert found.count() == 0 and len(centroids) == 0
    assert zonemap.summarised(found, centroids).count() == 0
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [5e-324, -5e-324])]
    found, centroids = zonemap.clusters(spark.createDataFrame(rows, schema), k=2, components=2, salt="2")
    assert len(centroids) == 2 and found.count() == 3
    assert zonemap.integers(spark.createDataFrame(rows, schema), 2).filter("vec_id = 3").first()["x"] == [0, -1]


def test_query_against_plain_integers(spark, sf_dir):
    table = queries.table(spark, sf_dir, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    centroids, assigned = plain(rows, 40, 5, "2", 64)
    got = queries.QUERIES["op12_centroid_clusters"](spark, sf_dir).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == assigned
    assert {r["centroid_sha256"] for r in got} <= {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids}
