import threading

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator

from crossfade.models import regressors as R
from crossfade.sources.staging import stage_path

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(2)
    x = rng.normal(0, [1, 2, 0.5], (300, 3))
    y = x @ [1.0, -0.4, 0.02] + 3 + rng.normal(0, 0.7, 300)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, arrays):
    x, y = arrays
    rows = [
        (f"e{i}", 1, "RB", float(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y))
    ]
    return spark.createDataFrame(
        rows, "gsis_id string, season int, position_group string, z_score double, a double, b double, c double"
    )


def _coefficients(model):
    fitted = model.stages[-1]
    return np.array([*fitted.coefficients, fitted.intercept])


def _descend(x, y, l1, l2):
    """Coordinate descent for (1/2n)||y - Xb||^2 + l1 |b| + l2/2 |b|^2."""
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    b = np.zeros(x.shape[1])
    for _ in range(2000):
        for j in range(len(b)):
            r = yc - xc @ b + xc[:, j] * b[j]
            rho = xc[:, j] @ r / n
            b[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (xc[:, j] @ xc[:, j] / n + l2)
    return np.array([*b, y.mean() - x.mean(0) @ b])


def test_ridge_is_the_closed_form(arrays, frame):
    x, y = arrays
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + 1.0 * np.eye(3), xc.T @ yc)
    expected = np.array([*b, y.mean() - x.mean(0) @ b])
    assert _coefficients(R.fit_ridge(frame, FEATURES)) == pytest.approx(expected, abs=1e-8)


def test_lasso_is_coordinate_descent(arrays, frame):
    got = _coefficients(R.fit_lasso(frame, FEATURES))
    assert got == pytest.approx(_descend(*arrays, 0.1, 0), abs=1e-6) and got[2] == 0


def test_elastic_net_is_coordinate_descent(arrays, frame):
    got = _coefficients(R.fit_elastic_net(frame, FEATURES))
    assert got == pytest.approx(_descend(*arrays, 0.05, 0.05), abs=1e-6)


def test_optimality_of_correlated_columns(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (500, 4))
    x = np.concatenate([base, base[:, :2] * 3 + 1e-3 * rng.normal(0, 1, (500, 2)), 1e6 + base[:, 2:3] ** 2, np.full((500, 1), 7.0)], axis=1)
    y = x @ [1, -1, 0.2, 0, 0.3, 0, 0.5, 1] + rng.normal(0, 0.5, 500)
    columns = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], [*columns, "z_score"])
    xc, yc = x - x.mean(0), y - y.mean()
    for model, l1, l2 in ((R.fit_lasso(df, columns, max_iter=100_000), 0.1, 0.0), (R.fit_elastic_net(df, columns), 0.05, 0.05)):
        b = _coefficients(model)[:-1]
        slope = xc.T @ (yc - xc @ b) / 500 - l2 * b
        # zero where the slope is within the penalty, else on its edge
        assert (np.abs(slope) <= l1 + 1e-6).all() and np.abs(slope - l1 * np.sign(b))[b != 0].max() < 1e-6
        assert b[-1] == 0


def test_products_of_shifted_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1e9 + i, float(i % 3)) for i in range(9)], "a double, b double")
    n, means, products = R.cross_products(df, ["a", "b"])
    assert n == 9 and means == pytest.approx([1e9 + 4, 1.0])
    assert products == pytest.approx(np.cov(np.array([np.arange(9.0), np.arange(9) % 3]), bias=True))
    n, means, products = R.cross_products(df.filter("b > 5"), ["a", "b"])
    assert n == 0 and not products.any()


def test_descent_says_when_it_has_not_converged():
    gram = np.array([[1.0, 0.999999], [0.999999, 1.0]])
    with pytest.raises(ArithmeticError):
        R.descend(gram, np.array([0.5, 0.4]), 1.0, 0.01, 0.0, 3)


def test_comparison_agrees_with_the_evaluator(frame):
    models = {
        "Ridge": R.fit_ridge(frame, FEATURES),
        "Random Forest": R.fit_random_forest(frame, FEATURES, trees=5, depth=4),
        "Gradient Boosting": R.fit_gradient_boosting(frame, FEATURES, rounds=3),
    }
    table = R.compare(models, frame)
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == set(models)
    for name, model in models.items():
        scored = R.predict(model, frame)
        for metric in ("r2", "rmse", "mae"):
            evaluator = RegressionEvaluator(labelCol="z_score", metricName=metric)
            assert rows[name][metric] == pytest.approx(evaluator.evaluate(scored))
    ordered = [r.r2 for r in table.collect()]
    assert ordered == sorted(ordered, reverse=True)
    assert R.rank_models(table).first().model == max(rows, key=lambda m: rows[m].r2)


def test_importance_and_top_k(spark, frame):
    forest = R.fit_random_forest(frame, FEATURES, trees=5, depth=4)
    importance = R.feature_importance(forest, spark)
    assert sum(r.importance for r in importance.collect()) == pytest.approx(1)
    assert R.topk_features(importance, 1).first().feature == "a"
    linear = R.feature_importance(R.fit_ridge(frame, FEATURES), spark)
    assert {r.importance for r in linear.collect()} == {1.0}


def test_save_and_load(spark, frame):
    model = R.fit_boosting_depth6(frame, FEATURES, rounds=2)
    path = stage_path(spark, "model")
    R.save_model(model, path)
    loaded = R.load_model(path)
    assert loaded.stages[0].getInputCols() == FEATURES
    a = R.predictions(model, frame).orderBy("gsis_id").collect()
    assert a == R.predictions(loaded, frame).orderBy("gsis_id").collect()
    assert a[0].error == pytest.approx(a[0].actual - a[0].predicted)


def test_model_frame(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, z_score double")
    assert [tuple(r) for r in R.model_frame(df, ["a"]).collect()] == [(0.0, 2.0)]
    assert [tuple(r) for r in R.model_frame(df, ["a"], zero_target=True).collect()] == [
        (1.0, 0.0), (0.0, 2.0),
    ]


def test_feature_rule(spark):
    df = spark.createDataFrame(
        [("e", 1, 2.0, 3, 0.5, "x")],
        "gsis_id string, season int, metric_raw double, volume int, z_score double, team string",
    )
    assert R.feature_columns(df) == ["metric_raw"]


def test_models_are_fitted_at_a_time(spark, monkeypatch):
    train = spark.createDataFrame([(float(i % 7), float(i % 5), float(i % 7 + 2 * (i % 5))) for i in range(60)], "a double, b double, z_score double")
    alone = R.fit_ridge(train, ["a", "b"]).stages[-1].coefficients.toArray()
    both = threading.Barrier(2, timeout=60)  # a fit that waits for the other to end breaks it

    def fit(*args):
        both.wait()
        return R.fit_ridge(*args)

    monkeypatch.setattr(R, "MODELS", {"x": fit, "y": fit})
    found = R.fit_models(train, ["a", "b"], ["x", "y"], parallel=2)
    assert list(found) == ["x", "y"]
    assert all((m.stages[-1].coefficients.toArray() == alone).all() for m in found.values())
