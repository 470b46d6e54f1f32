import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfade.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def brute(rows, k):
    rows = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows]
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            near = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q and len(y) == len(x)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def found(frame, **options):
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_on_graphs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + rng.normal(size=24)).tolist()) for i in range(1500)]
    frame = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    got = found(frame, k=20, how=ann.Graph(query_beam=100, batch=128), shard_size=800, block_size=40)
    want = brute(rows, 20)
    hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    assert all(s == pytest.approx(float(np.dot(np.float32(rows[q][1]).astype(float), np.float32(rows[i][1]).astype(float)))) for q in got for i, s in got[q])


def test_equal_vectors_ties_and_what_takes_no_part(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 120)] + [(200, [3.0, -1.0]), (201, [0.5, 0.5]), (220, [1.0, 0.0, 1.0]), (221, [2.0, 1.0, 0.0])]
    out = [(300, None), (320, [0.0, 0.0]), (340, [float("nan"), 1.0]), (341, [float("inf"), 1.0]), (342, [None, 1.0]), (None, [1.0, 1.0]), (360, [])]
    frame = spark.createDataFrame([(*r, "x") for r in [*rows, rows[0], rows[5], *out]], SCHEMA)
    assert found(frame, k=20, shard_size=50) == brute(rows, 20)
    assert found(frame, k=3, shard_size=1, block_size=1) == brute(rows, 3)


def test_empty_and_alone(spark):
    frame = spark.createDataFrame([(20, [1.0], None)], SCHEMA)
    assert found(frame) == {}
    assert found(frame.limit(0)) == {}


def test_pruning_keeps_near_and_diverse():
    x = ann._lift(np.array([[1.0, 0.0], [0.99, 0.1], [0.98, 0.12], [0.0, 1.0]]), 1.0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = ann._prune(x, 1.0, np.array([0]), np.array([[1, 2, 3, 1, -1, 4]]), 3, 1.2)
    assert set(kept[0]) - {4} == {1, 3}
