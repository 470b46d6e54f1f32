import numpy as np
import pytest

from crossfade.operators import smooth


def brute_loess(x, y, points, span=0.75, level=0.95):
    """Local regressions on the raw rows, one point after the other, and the whole smoothing matrix."""
    n = len(x)
    q = max(int(n * span + 1e-5), 1)
    values, slopes, rows, slope_rows = [], [], [], []
    for v in points:
        d = np.abs(x - v)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0) if h > 0 else (d == 0).astype(float)
        z = (x - v) / h if h > 0 else np.zeros(n)
        basis = np.stack([np.ones(n), z, z * z], axis=1)
        solution = np.linalg.pinv(np.sqrt(w)[:, None] * basis, rcond=1e-6) * np.sqrt(w)
        rows.append(solution[0])
        slope_rows.append(solution[1] / h if h > 0 else np.zeros(n))
    rows, slope_rows = np.array(rows), np.array(slope_rows)
    smoother = np.zeros((n, n))
    for i, v in enumerate(x):
        j = max(np.searchsorted(points, v, side="right") - 1, 0)
        k = min(j + 1, len(points) - 1)
        gap = points[k] - points[j]
        t = (v - points[j]) / gap if gap else 0.0
        smoother[i] = (1 + 2 * t) * (1 - t) ** 2 * rows[j] + t * (1 - t) ** 2 * gap * slope_rows[j]
        smoother[i] += t * t * (3 - 2 * t) * rows[k] + t * t * (t - 1) * gap * slope_rows[k]
    residual = y - smoother @ y
    df = n - np.trace(smoother)
    se = np.sqrt(residual @ residual / df * (rows**2).sum(axis=1))
    return rows @ y, se, df


@pytest.mark.parametrize("p,df,expected", [(0.975, 1, 12.706204736), (0.975, 3, 3.182446305), (0.975, 10, 2.228138852), (0.975, 1e6, 1.959966), (0.995, 2, 9.924843201)])
def test_t_quantile(p, df, expected):
    assert smooth.t_quantile(p, df) == pytest.approx(expected, rel=1e-6)


def check(spark, groups, kind, points, **how):
    rows = [(g, v, float(w), "z") for g, (x, y) in groups.items() for v, w in zip(x.tolist(), y.tolist())]
    rows += [("a", None, 1.0, "z"), ("a", rows[0][1], None, "z")]
    df = spark.createDataFrame(rows, f"position_group string, rel_time {kind}, z_score double, n string")
    got = {}
    for r in smooth.loess(df, **how).orderBy("rel_time").collect():
        got.setdefault(r["position_group"], []).append(r)
    assert set(got) == set(groups)
    for g, (x, y) in groups.items():
        fit, se, dof = brute_loess(x.astype(float), y, points(x))
        assert [r["rel_time"] for r in got[g]] == pytest.approx(points(x))
        assert [r["fit"] for r in got[g]] == pytest.approx(fit, abs=1e-9)
        assert [r["se"] for r in got[g]] == pytest.approx(se, abs=1e-9)
        assert got[g][0]["df"] == pytest.approx(dof, abs=1e-8) and got[g][0]["n"] == len(x)
        t = smooth.t_quantile(0.975, dof)
        assert [r["low"] for r in got[g]] == pytest.approx(fit - t * se, abs=1e-8)
        assert [r["high"] for r in got[g]] == pytest.approx(fit + t * se, abs=1e-8)


def test_loess_of_many_distinct_x_is_that_of_the_raw_rows(spark):
    rng = np.random.default_rng(1)
    x, u = rng.uniform(-3, 7, 400), rng.exponential(1, 300)
    groups = {"a": (x, np.sin(x) + rng.normal(0, 0.3, 400)), None: (u, 5 + u**2 + rng.normal(0, 1, 300))}
    check(spark, groups, "double", lambda x: np.linspace(x.min(), x.max(), 80))


def test_loess_of_whole_numbers_at_their_own_values(spark):
    rng = np.random.default_rng(2)
    x = rng.choice(np.arange(-4, 5), 500, p=np.array([1, 2, 3, 4, 20, 4, 3, 2, 1]) / 40)
    check(spark, {"a": (x, rng.normal(0, 1, 500) + 0.1 * x)}, "int", lambda x: np.unique(x).astype(float))


def test_loess_edges(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "x int, y double")
    (row,) = smooth.loess(df, "x", "y", by=()).collect()
    assert (row["x"], row["fit"], row["n"]) == (1.0, 3.0, 2) and row["df"] == pytest.approx(1)
    (row,) = smooth.loess(df.limit(1), "x", "y", by=()).collect()
    assert row["fit"] in (2.0, 4.0) and row["se"] is None and row["low"] is None
    assert smooth.loess(df.filter("x > 5"), "x", "y", by=()).count() == 0
    with pytest.raises(ValueError):
        smooth.loess(df, "x", "y", by=(), span=1.5)


def dense_basis(x, knots):
    """The natural cubic spline through each unit vector at the knots, by a solve for all second derivatives."""
    k, h = len(knots), np.diff(knots)
    system, right = np.eye(k), np.zeros((k, k))
    for i in range(1, k - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    second = np.linalg.solve(system, right)
    j = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, k - 2)
    a, b = (knots[j + 1] - x) / h[j], (x - knots[j]) / h[j]
    eye = np.eye(k)
    basis = a[:, None] * eye[j] + b[:, None] * eye[j + 1]
    basis += ((a**3 - a) * h[j] ** 2 / 6)[:, None] * second[j] + ((b**3 - b) * h[j] ** 2 / 6)[:, None] * second[j + 1]
    penalty = sum(h[i] / 3 * (np.outer(second[i], second[i]) + np.outer(second[i + 1], second[i + 1]) + (np.outer(second[i], second[i + 1]) + np.outer(second[i + 1], second[i])) / 2) for i in range(k - 1))
    return basis, penalty


def test_spline_is_the_dense_penalised_solve(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.gamma(2, 2, 600), 2)
    y = 100 + np.cos(x) + rng.normal(0, 0.4, 600)
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (1.0, None)], "predicted double, error double")
    found = smooth.fit_spline(df)
    knots = np.quantile(np.unique(x), np.linspace(0, 1, 10))
    assert found["knots"] == pytest.approx(knots)
    basis, penalty = dense_basis(x, knots)

    def gcv(weight):
        hat = basis @ np.linalg.solve(basis.T @ basis + weight * penalty, basis.T)
        residual = y - hat @ y
        return 600 * residual @ residual / (600 - np.trace(hat)) ** 2, np.trace(hat)

    score, edf = gcv(found["penalty"])
    assert (found["gcv"], found["edf"]) == pytest.approx((score, edf), rel=1e-7)
    assert all(score <= gcv(found["penalty"] * f)[0] + 1e-12 for f in (1e-6, 0.1, 0.9, 1.1, 10, 1e6))
    solution = np.linalg.solve(basis.T @ basis + found["penalty"] * penalty, basis.T @ y)
    assert found["values"] == pytest.approx(solution, abs=1e-6)
    curve = smooth.spline_curve(df).orderBy("predicted").collect()
    grid = np.linspace(x.min(), x.max(), 80)
    assert [r["predicted"] for r in curve] == pytest.approx(grid)
    assert [r["fit"] for r in curve] == pytest.approx(dense_basis(grid, knots)[0] @ solution, abs=1e-6)


def test_spline_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (3.0, 7.0)], "predicted double, error double")
    curve = smooth.spline_curve(df, points=3).orderBy("predicted").collect()
    assert [v for r in curve for v in r[:2]] == pytest.approx([1.0, 3.0, 2.0, 5.0, 3.0, 7.0])
    assert [v for r in smooth.spline_curve(df.filter("predicted < 2")).collect() for v in r[:2]] == pytest.approx([1.0, 3.0])
    assert smooth.spline_curve(df.filter("predicted > 9")).count() == 0
    line = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(40)], "predicted double, error double")
    assert [r["fit"] for r in smooth.spline_curve(line).collect()] == pytest.approx([2 * r["predicted"] + 1 for r in smooth.spline_curve(line).collect()], abs=1e-6)
