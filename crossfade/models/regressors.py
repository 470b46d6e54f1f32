"""Regression models and their comparison."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfade.operators.charts import metric_columns, residual_columns
from crossfade.operators.clean import fill_zero
from crossfade.operators.filters import MODEL_EXCLUDED, numeric_columns
from crossfade.sources.staging import shared_folder

TARGET = "z_score"


def feature_columns(
    df: DataFrame, exclude: Sequence[str] = MODEL_EXCLUDED, target: str = TARGET
) -> list[str]:
    return numeric_columns(df, [*exclude, target])


def model_frame(
    df: DataFrame,
    features: Sequence[str],
    target: str = TARGET,
    zero_target: bool = False,
) -> DataFrame:
    """Features with 0 for missing; rows without a target are dropped unless
    ``zero_target`` fills those as well."""
    out = fill_zero(df, features)
    return fill_zero(out, [target]) if zero_target else out.dropna(subset=[target])


def _fit(train: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    vectors = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[vectors, estimator]).fit(train)


def _label_scale(train: DataFrame, target: str) -> tuple[int, float]:
    row = train.agg(F.count(target), F.stddev_pop(target)).first()
    return row[0], row[1]


def fit_ridge(
    train: DataFrame, features: Sequence[str], target: str = TARGET, alpha: float = 1.0
) -> PipelineModel:
    """Squared error plus ``alpha`` times the squared coefficients.

    Spark divides its penalty by the label's deviation and its loss by the row
    count; the parameter undoes both.
    """
    n, sd = _label_scale(train, target)
    linear = LinearRegression(labelCol=target, regParam=alpha * sd / n, elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-9)
    return _fit(train, features, linear)


def cross_products(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """``(n, means, products)``: the columns' mean products around their means.

    Two aggregations: the means first, so that products don't cancel. A task
    passes on one row of sums per column.
    """
    row = df.agg(F.count(F.lit(1)), *(F.avg(c) for c in columns)).first()
    n, means = row[0], np.array([0.0 if v is None else v for v in row[1:]])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(means), len(means)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - means
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(means))), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    values = df.select(*(F.col(c).cast("double") for c in columns))
    sums = values.mapInArrow(products, "i bigint, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    found = np.zeros((len(means), len(means)))
    for cell in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # a row per pair of columns
        found[cell["i"], cell["j"]] = cell["v"]
    return n, means, found / max(n, 1)


def descend(gram: np.ndarray, cross: np.ndarray, square: float, l1: float, l2: float, max_iter: int, tol: float = 1e-14) -> np.ndarray:
    """Coordinate descent on mean products: ``1/2 b'Gb - c'b + l1 |b| + l2/2 b'b`` is least.

    It ends when the duality gap is below ``tol`` of the target's mean square,
    or raises after ``max_iter`` sweeps.
    """
    b = np.zeros(len(cross))
    if not square:
        return b
    for _ in range(max_iter):
        for j in range(len(b)):
            scale = gram[j, j] + l2
            rho = cross[j] - gram[j] @ b + gram[j, j] * b[j]
            b[j] = np.sign(rho) * max(abs(rho) - l1, 0.0) / scale if scale > 0 else 0.0
        along = cross - gram @ b  # the residual's mean products with the columns
        residual = square - 2 * cross @ b + b @ gram @ b
        dual = np.abs(along - l2 * b).max()
        shrink = min(1.0, l1 / dual) if dual > 0 else 1.0
        gap = (1 + shrink**2) / 2 * residual + l1 * np.abs(b).sum() - shrink * (square - cross @ b) + l2 / 2 * (1 + shrink**2) * b @ b
        if gap <= tol * square:
            return b
    raise ArithmeticError(f"duality gap {gap:.3g} after {max_iter} sweeps")


def _fit_descent(train: DataFrame, features: Sequence[str], target: str, l1: float, l2: float, max_iter: int) -> PipelineModel:
    """Two passes over the rows, whatever the number of sweeps."""
    _, means, products = cross_products(train, [*features, target])
    b = descend(products[:-1, :-1], products[:-1, -1], products[-1, -1], l1, l2, max_iter)
    context = train.sparkSession.sparkContext
    vectors = VectorAssembler(inputCols=list(features), outputCol="features")
    linear = context._jvm.org.apache.spark.ml.regression.LinearRegressionModel
    fitted = linear(f"linReg_{uuid.uuid4().hex[:12]}", _py2java(context, Vectors.dense(b)), float(means[-1] - means[:-1] @ b))
    return PipelineModel([vectors, LinearRegressionModel(fitted)])


def fit_lasso(
    train: DataFrame,
    features: Sequence[str],
    target: str = TARGET,
    alpha: float = 0.1,
    max_iter: int = 5000,
) -> PipelineModel:
    """Half the mean squared error plus ``alpha`` times the sum of the coefficients' sizes."""
    return _fit_descent(train, features, target, alpha, 0.0, max_iter)


def fit_elastic_net(
    train: DataFrame,
    features: Sequence[str],
    target: str = TARGET,
    alpha: float = 0.1,
    l1_ratio: float = 0.5,
    max_iter: int = 5000,
) -> PipelineModel:
    """Half the mean squared error plus ``alpha`` times a mix of sizes and half squares of the coefficients."""
    return _fit_descent(train, features, target, alpha * l1_ratio, alpha * (1 - l1_ratio), max_iter)


def fit_random_forest(
    train: DataFrame,
    features: Sequence[str],
    target: str = TARGET,
    trees: int = 100,
    depth: int = 10,
    min_split: int = 20,
    seed: int = 42,
) -> PipelineModel:
    """MLlib bounds the leaf size, not the split size: half of it per side.

    The larger node buffer and the kept node ids save passes over the rows:
    more nodes are split per pass, and no pass walks the trees again.
    """
    shared_folder(train.sparkSession)
    forest = RandomForestRegressor(
        labelCol=target,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=max(1, min_split // 2),
        featureSubsetStrategy="all",
        seed=seed,
        maxMemoryInMB=1024,
        cacheNodeIds=True,
        checkpointInterval=10,
    )
    return _fit(train, features, forest)


def fit_gradient_boosting(
    train: DataFrame,
    features: Sequence[str],
    target: str = TARGET,
    rounds: int = 100,
    depth: int = 5,
    rate: float = 0.1,
    seed: int = 42,
) -> PipelineModel:
    """The residuals of every tenth round are checkpointed to the shared folder."""
    shared_folder(train.sparkSession)
    boosting = GBTRegressor(
        labelCol=target,
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        seed=seed,
        checkpointInterval=10,
    )
    return _fit(train, features, boosting)


def fit_boosting_depth6(
    train: DataFrame, features: Sequence[str], target: str = TARGET, rounds: int = 100
) -> PipelineModel:
    return fit_gradient_boosting(train, features, target, rounds, depth=6)


# The model names of the comparison table.
MODELS = {
    "Ridge": fit_ridge,
    "Lasso": fit_lasso,
    "ElasticNet": fit_elastic_net,
    "Random Forest": fit_random_forest,
    "Gradient Boosting": fit_gradient_boosting,
    "Boosting Depth 6": fit_boosting_depth6,
}


def fit_models(
    train: DataFrame, features: Sequence[str], names: Sequence[str] = tuple(MODELS), parallel: int = 3
) -> dict[str, PipelineModel]:
    """The named models, up to ``parallel`` of them fitted at a time.

    A boosting round is a few short jobs, one after the other; the jobs of
    another fit use the cores they leave idle. Each model is what it is alone.
    """
    start = inheritable_thread_target(train.sparkSession)
    pool = ThreadPool(max(1, min(parallel, len(names))))
    try:
        fitted = pool.map(lambda fit: fit(), [start(lambda n=n: MODELS[n](train, features)) for n in names], chunksize=1)
    finally:
        pool.close()
    return dict(zip(names, fitted))


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    scored = model.transform(df).drop("features")
    return scored if out == "prediction" else scored.withColumnRenamed("prediction", out)


def compare(
    models: Mapping[str, PipelineModel], test: DataFrame, target: str = TARGET
) -> DataFrame:
    """R2, RMSE and MAE per model, from one pass over the test rows."""
    scored = test
    for i, model in enumerate(models.values()):
        scored = predict(model, scored, f"_p{i}")
    row = scored.agg(
        *[m for i in range(len(models)) for m in metric_columns(target, f"_p{i}", f"_{i}_")]
    )
    entries = [
        F.struct(
            F.lit(name).alias("model"),
            *[F.col(f"_{i}_{m}").alias(m) for m in ("r2", "rmse", "mae")],
        )
        for i, name in enumerate(models)
    ]
    return row.select(F.inline(F.array(*entries))).orderBy(F.desc("r2"), "model")


def rank_models(comparison: DataFrame, k: int = 1) -> DataFrame:
    """The best ``k`` models by R2, ties by name."""
    return comparison.orderBy(F.desc("r2"), "model").limit(k)


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """Importance per feature; 1 each for a linear model."""
    names = model.stages[0].getInputCols()
    fitted = model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        values = [float(v) for v in fitted.featureImportances.toArray()]
    else:
        values = [1.0] * len(names)
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


def topk_features(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def predictions(
    model: PipelineModel,
    test: DataFrame,
    target: str = TARGET,
    keys: Sequence[str] = ("gsis_id", "season"),
) -> DataFrame:
    return residual_columns(predict(model, test), target, keys=keys)


def save_model(model: PipelineModel, path: str) -> None:
    """The model with its feature list (the assembler's inputs)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
