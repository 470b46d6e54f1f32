import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfade.operators.quantiles import medians, quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(3000):
        # one value holds a third of all rows
        x = 1.5 if rng.random() < 0.34 else rng.gauss(0, 100)
        out.append((
            rng.choice(["a", "b", None]), None if rng.random() < 0.1 else x,
            float(rng.randrange(5)), rng.choice([1e-300, -0.0, 0.0, 1e300, rng.random()]),
        ))
    out.append(("lonely", 4.0, None, 1.0))
    return out


def _expected(rows, group, i):
    values = [r[i] for r in rows if r[0] == group and r[i] is not None]
    return [None] * len(PROBS) if not values else list(np.percentile(values, [p * 100 for p in PROBS]))


def test_grouped(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    out = quantiles(df, ["x", "y", "z"], PROBS, ["g"])
    got = {r.g: r for r in out.collect()}
    assert set(got) == {"a", "b", None, "lonely"}
    for g, r in got.items():
        for i, c in ((1, "x"), (2, "y"), (3, "z")):
            expected = _expected(rows, g, i)
            if expected[0] is None:
                assert r[c] is None or all(v is None for v in r[c])
            else:
                assert r[c] == pytest.approx(expected, rel=1e-12, abs=1e-12)


def test_whole_column(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    out = medians(df, ["x", "y"]).first()
    assert out.x == pytest.approx(np.median([r[1] for r in rows if r[1] is not None]))
    assert out.y == pytest.approx(np.median([r[2] for r in rows if r[2] is not None]))


def test_numbers_of_percentile(spark, rows):
    inf = float("inf")
    odd = [("i", v) for v in (1.0, 2.0, 3.0, inf, inf, inf)] + [("h", -1.7e308), ("h", 1.7e308), ("n", float("nan")), ("n", 1.0), ("n", None), ("z", None)]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows] + odd, "g string, x double").repartition(7)
    points = [0.0, 0.05, 0.3, 0.5, 0.75, 0.99, 1.0]
    ours = {r.g: r.x for r in quantiles(df, ["x"], points, ["g"]).collect()}
    theirs = {r.g: r.x for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, points))).alias("x")).collect()}
    assert repr(ours) == repr({g: theirs[g] for g in ours}) and set(ours) == set(theirs)


def test_without_rows(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert quantiles(df, ["x"], [0.5]).collect()[0].x is None
    assert quantiles(df, ["x"], [0.5], ["g"]).count() == 0


def test_sketch_is_close(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    out = quantiles(df, ["x"], [0.5], exact=False).first().x[0]
    assert out == pytest.approx(1.5)
