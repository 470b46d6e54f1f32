"""Grouped REML against the dense formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfade.models import mixed


def _data(seed=11, n=60, slope=True):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(n):
        u0, u1 = rng.normal(0, 1.0), rng.normal(0, 0.6)
        for t in range(-2, 3):
            if rng.random() < 0.25:
                continue
            x, post = rng.normal(), int(t >= 0)
            sd = 0.5 + 0.5 * post
            y = 1 + 0.5 * x + 0.3 * post + u0 + (u1 * t if slope else 0) + rng.normal(0, sd)
            rows.append((f"e{e}", t, float(x), post, float(y)))
    return rows


SCHEMA = "gsis_id string, t int, x double, post int, y double"


@pytest.fixture(scope="module")
def rows():
    return _data()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _fixed():
    return {"x": F.col("x"), "post": F.col("post")}


def _dense(rows, model):
    """REML criterion, coefficients and random effects with full matrices."""
    ids = sorted({r[0] for r in rows})
    X = np.array([[1.0, r[2], r[3]] for r in rows])
    y = np.array([r[4] for r in rows])
    w = np.array([model.weights[r[3]] if model.phase else 1.0 for r in rows])
    q = model.factor.shape[0]
    Z = np.zeros((len(rows), q * len(ids)))
    for i, r in enumerate(rows):
        k = ids.index(r[0]) * q
        Z[i, k] = 1.0
        if q == 2:
            Z[i, k + 1] = r[1]
    D = np.kron(np.eye(len(ids)), model.covariance)
    V = Z @ D @ Z.T + model.sigma2 * np.diag(w)
    Vi = np.linalg.inv(V)
    A = X.T @ Vi @ X
    beta = np.linalg.solve(A, X.T @ Vi @ y)
    e = y - X @ beta
    n, p = X.shape
    deviance = (
        np.linalg.slogdet(V)[1] + np.linalg.slogdet(A)[1] + e @ Vi @ e
        + (n - p) * math.log(2 * math.pi)
    )
    u = (D @ Z.T @ Vi @ e).reshape(len(ids), q)
    return deviance, beta, np.linalg.inv(A), dict(zip(ids, u)), X @ beta + Z @ u.ravel()


@pytest.mark.parametrize("slope,phase", [(None, None), ("t", None), ("t", "post"), (None, "post")])
def test_equals_dense_matrices(spark, rows, df, slope, phase):
    model = mixed.fit_lmm(df, "y", _fixed(), slope=slope, phase=phase)
    deviance, beta, covariance, u, fitted = _dense(rows, model)
    assert model.deviance == pytest.approx(deviance, rel=1e-10)
    assert model.beta == pytest.approx(beta, rel=1e-8)
    assert model.cov_beta == pytest.approx(covariance, rel=1e-7)
    assert (model.n_rows, model.n_entities) == (len(rows), len(u))
    for r in mixed.random_effects(model).collect():
        assert list(r)[1:] == pytest.approx(list(u[r.gsis_id]), abs=1e-8)
    got = {
        (r.gsis_id, r.t): (r.fitted, r.residual)
        for r in mixed.fitted_residuals(model, df, ["gsis_id", "t"]).collect()
    }
    for r, f in zip(rows, fitted):
        assert got[r[0], r[1]] == pytest.approx((f, r[4] - f), abs=1e-8)


@pytest.mark.parametrize("slope,phase", [("t", None), ("t", "post")])
def test_optimum(rows, df, slope, phase):
    """No nearby variance parameters have a lower criterion."""
    model = mixed.fit_lmm(df, "y", _fixed(), slope=slope, phase=phase)
    best = _dense(rows, model)[0]
    factor, weights, sigma2 = model.factor.copy(), model.weights.copy(), model.sigma2
    for i, j in ((0, 0), (1, 0), (1, 1)):
        for step in (-0.02, 0.02):
            model.factor = factor.copy()
            model.factor[i, j] += step
            assert _dense(rows, model)[0] >= best - 1e-7
    model.factor = factor
    for scale in (0.98, 1.02):
        model.sigma2 = sigma2 * scale
        assert _dense(rows, model)[0] >= best - 1e-7
        model.sigma2 = sigma2
        if phase:
            model.weights = weights * np.array([1, scale])
            assert _dense(rows, model)[0] >= best - 1e-7
            model.weights = weights


def test_distributed_evaluation_gives_the_same_fit(df):
    near = mixed.fit_lmm(df, "y", {}, slope=None)
    far = mixed.fit_lmm(df, "y", {}, slope=None, pattern_limit=2)
    assert far.deviance == pytest.approx(near.deviance, rel=1e-12)
    assert far.beta == pytest.approx(near.beta) and far.n_entities == near.n_entities


def test_patterns_do_not_grow_with_the_entities(spark):
    counts = []
    for n in (100, 400):
        df = spark.createDataFrame(_data(5, n), SCHEMA)
        design = mixed._design(df, "y", _fixed(), "gsis_id", "t", None)
        entities = mixed._entity_statistics(design, 3, True, 1)
        counts.append(mixed._pattern_table(entities, 3, 2, 1).count())
    assert counts[1] <= 31 and counts[0] <= counts[1]


def test_row_order_and_incomplete_rows(spark, rows, df):
    model = mixed.fit_lmm(df, "y", _fixed(), slope="t")
    extra = [("e0", 1, None, 1, 5.0), ("e1", 1, 0.0, 1, None), (None, 1, 0.0, 1, 1.0)]
    shuffled = spark.createDataFrame(rows[::-1] + extra, SCHEMA)
    again = mixed.fit_lmm(shuffled, "y", _fixed(), slope="t")
    assert again.deviance == pytest.approx(model.deviance, rel=1e-9)
    assert again.n_rows == model.n_rows


def test_no_entity_variance_gives_a_singular_fit(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{e}", 0, 0.0, 0, float((-1) ** i + 0.1 * rng.normal())) for e in range(30) for i in range(4)]
    model = mixed.fit_lmm(spark.createDataFrame(rows, SCHEMA), "y", {})
    assert model.covariance[0, 0] == pytest.approx(0, abs=1e-6)


def test_likelihood_ratio(spark, df):
    by_phase = mixed.fit_lmm(df, "y", _fixed(), slope="t", phase="post")
    equal = mixed.fit_lmm(df, "y", _fixed(), slope="t")
    row = mixed.likelihood_ratio(by_phase, equal, spark).first()
    assert row.ratio > 3.84 and row.p_value < 0.05
    assert row.ratio == pytest.approx(2 * (row.loglik_phases - row.loglik_equal))
    with pytest.raises(ValueError):
        mixed.likelihood_ratio(by_phase, mixed.fit_lmm(df, "y", {}, slope="t"), spark)


def test_tables(spark, df):
    model = mixed.fit_lmm(df, "y", _fixed(), slope="t", phase="post")
    fixed = mixed.fixed_effect_table(model, spark).collect()
    assert [r.term for r in fixed] == ["(Intercept)", "x", "post"]
    assert fixed[1].t_value == pytest.approx(fixed[1].estimate / fixed[1].std_error)
    assert fixed[0].correlation[0] == pytest.approx(1)
    spread = {r.component: r for r in mixed.variance_table(model, spark).collect()}
    assert spread["residual_phase_1"].value > spread["residual_phase_0"].value
    assert -1 <= spread["entity_slope"].correlation <= 1


def test_marginal_effects(spark):
    rng = np.random.default_rng(9)
    rows = [
        (f"e{e}", t, float(rng.normal()), int(t >= 0), float(rng.normal()), "AB"[e % 2])
        for e in range(40) for t in range(-2, 3)
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", g string")
    is_b = (F.col("g") == "B").cast("int")
    fixed = {"post": F.col("post"), "gB": is_b, "x": F.col("x"), "post:gB": is_b * F.col("post")}
    model = mixed.fit_lmm(df, "y", fixed)
    out = mixed.marginal_effects(model, df, "post", ["A", "B"], {"B": "gB"}, {"B": "post:gB"})
    got = {(r.position_group, r.post_transition): r.predicted for r in out.collect()}
    b = dict(zip(model.names, model.beta))
    centre = b["(Intercept)"] + b["x"] * np.mean([r[2] for r in rows])
    assert got["A", 0] == pytest.approx(centre)
    assert got["B", 1] == pytest.approx(centre + b["post"] + b["gB"] + b["post:gB"])


def test_anova(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 6.0), ("b", 8.0), ("b", None)]
    row = mixed.anova_icc(spark.createDataFrame(rows, "gsis_id string, z_score double")).first()
    assert (row.n_entities, row.n_rows) == (2, 4)
    assert row.ms_between == pytest.approx(25) and row.ms_within == pytest.approx(2)
    assert row.icc == pytest.approx(11.5 / 13.5)


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e6, 1.0), (1e8, 1.0), (-3e4, 1e4), (5.0, 1e-4)])
def test_fit_does_not_depend_on_origin_and_unit(spark, shift, scale):
    rng = np.random.default_rng(8)
    rows = [
        (f"e{e}", float(t), float(a), float(1 + 0.3 * t - 0.2 * a + u + v * t + rng.normal() * 0.5))
        for e in range(60)
        for u, v in [rng.normal(size=2) * (1.0, 0.3)]
        for t, a in zip((-2, -1, 0, 1.5, 2.25), rng.normal(25, 4, 5))
    ]
    df = spark.createDataFrame(rows, "gsis_id string, t double, a double, y double")
    fixed = {"a": F.col("a"), "t": F.col("t")}
    plain = mixed.fit_lmm(df, "y", fixed, slope="t")
    moved = df.withColumns({"y": F.col("y") * scale + shift, "a": F.col("a") * scale + shift})
    other = mixed.fit_lmm(moved, "y", fixed, slope="t")
    assert other.converged and other.evaluations < 2000
    rel = 1e-5 if shift < 1e8 else 1e-4  # a double keeps 8 digits of y behind the point
    assert other.sigma2 / scale**2 == pytest.approx(plain.sigma2, rel=rel)
    assert np.allclose(other.covariance / scale**2, plain.covariance, rtol=50 * rel, atol=1e-6)
    assert other.beta[1:] * (1, 1 / scale) == pytest.approx(plain.beta[1:], rel=50 * rel, abs=1e-6)
    ours, theirs = (
        {r.gsis_id: r.intercept for r in mixed.random_effects(m).collect()} for m in (plain, other)
    )
    assert all(theirs[e] / scale == pytest.approx(ours[e], abs=1e-3) for e in ours)


def test_no_rows_is_an_error(spark):
    with pytest.raises(ValueError):
        mixed.fit_lmm(spark.createDataFrame([], "gsis_id string, y double"), "y", {})


def test_scaled_residuals_and_held_terms(spark):
    rng = np.random.default_rng(2)
    rows = [(f"e{e}", t, int(t >= 0), float(e % 5 + 0.2 * t + rng.normal() * (1 + (t >= 0)))) for e in range(40) for t in range(-2, 3)]
    df = spark.createDataFrame(rows, "gsis_id string, t int, post int, y double")
    model = mixed.fit_lmm(df, "y", {"post": F.col("post")}, phase="post")
    five = mixed.scaled_residuals(model, df).first()
    sd = np.sqrt(model.sigma2 * model.weights)
    values = [r.residual / sd[r.post] for r in mixed.fitted_residuals(model, df, ["gsis_id", "post"]).collect()]
    assert list(five) == pytest.approx(list(np.percentile(values, [0, 25, 50, 75, 100])))
    free = mixed.fit_lmm(df, "y", {"post": F.col("post"), "t": F.col("t")})
    at = mixed.marginal_effects(free, df, "post", ["a"], {}, {}, {"t": 1.5}).filter("post_transition = 0").first()
    assert at.predicted == pytest.approx(free.beta[0] + 1.5 * free.beta[2])
