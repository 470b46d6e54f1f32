"""The tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfade.operators.joins import attach
from crossfade.operators.quantiles import quantiles
from crossfade.sources.staging import stage


def trajectory_by_position(
    panel: DataFrame, group: str = "position_group", rel: str = "rel_time", y: str = "z_score"
) -> DataFrame:
    """Mean and standard error of the metric per group and relative time."""
    return panel.groupBy(group, rel).agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean_z"),
        (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("se_z"),
    )


def boxplot_stats(
    df: DataFrame,
    by: Sequence[str] = ("position_group", "phase"),
    y: str = "team_quality",
    reach: float = 1.5,
    **options,
) -> DataFrame:
    """Quartiles, whiskers at the last value within reach, outlier count."""
    quarters = quantiles(df, [y], [0.25, 0.5, 0.75], by, **options)
    q = F.col(y)
    fences = stage(
        quarters.select(*by, q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")), "fences"
    )
    spread = F.col("q3") - F.col("q1")
    inside = F.col(y).between(
        F.col("q1") - reach * spread, F.col("q3") + reach * spread
    )
    return (
        attach(df.select(*by, y), fences, by, "inner")
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(y))).alias("whisker_low"),
            F.max(F.when(inside, F.col(y))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def pre_post_change(
    panel: DataFrame,
    keys: Sequence[str] = ("gsis_id", "position_group", "pre_trend_slope"),
    rel: str = "rel_time",
    y: str = "z_score",
) -> DataFrame:
    """Mean before, mean after, and their difference."""
    means = panel.groupBy(*keys).agg(
        F.avg(F.when(F.col(rel) < 0, F.col(y))).alias("pre_mean"),
        F.avg(F.when(F.col(rel) >= 0, F.col(y))).alias("post_mean"),
    )
    return means.withColumn("post_change", F.col("post_mean") - F.col("pre_mean"))


def trend_lines(
    df: DataFrame,
    by: Sequence[str] = ("position_group",),
    x: str = "pre_trend_slope",
    y: str = "post_change",
) -> DataFrame:
    """Least-squares line of y on x per group."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def qq_points(
    df: DataFrame, value: str = "residual", points: int = 99, exact: bool = True, **options
) -> DataFrame:
    """Sample against normal quantiles on a fixed grid, with the quartile line.

    The grid has a fixed size, so no global sort of the residuals is needed.
    """
    probs = [(i + 1) / (points + 1) for i in range(points)]
    normal = [NormalDist().inv_cdf(p) for p in probs]
    low, high = NormalDist().inv_cdf(0.25), NormalDist().inv_cdf(0.75)
    row = quantiles(df, [value], [*probs, 0.25, 0.75], exact=exact, **options)
    q = F.col(value)
    slope = (q[points + 1] - q[points]) / F.lit(high - low)
    entries = [
        F.struct(
            F.lit(p).alias("probability"),
            F.lit(t).alias("theoretical"),
            q[i].alias("sample"),
            (q[points] + slope * F.lit(t - low)).alias("line"),
        )
        for i, (p, t) in enumerate(zip(probs, normal))
    ]
    return row.select(F.inline(F.array(*entries)))


def _bucket(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal bins over [low, high]; the top value belongs to the last one."""
    if low == high:
        return F.when(value.isNotNull(), 1)
    bucket = F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins))
    # least() alone would put a missing value into the last bin
    return F.when(value.isNotNull(), F.least(bucket, F.lit(bins)))


def _range(df: DataFrame, value: str) -> tuple[float, float] | None:
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    return None if low is None else (low, high)


def residual_vs_fitted(
    df: DataFrame, fitted: str = "predicted", residual: str = "error", bins: int = 20
) -> DataFrame:
    """Mean residual per bin of the fitted value."""
    low, high = _range(df, fitted) or (0.0, 0.0)
    return (
        df.select(_bucket(F.col(fitted), low, high, bins).alias("bin"), fitted, residual)
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(fitted).alias("mean_fitted"),
            F.avg(residual).alias("mean_residual"),
        )
    )


def error_histogram(df: DataFrame, error: str = "error", bins: int = 30) -> DataFrame:
    """Row count per equal bin of the error, empty bins left out."""
    low, high = _range(df, error) or (0.0, 0.0)
    width = (high - low) / bins
    return (
        df.select(_bucket(F.col(error), low, high, bins).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("bin").cast("int").alias("bin"),
            (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("bin_low"),
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_high"),
            "n",
        )
    )


def prediction_range(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Ends of the identity line."""
    return df.agg(
        F.least(F.min(actual), F.min(predicted)).alias("min_val"),
        F.greatest(F.max(actual), F.max(predicted)).alias("max_val"),
    )


def residual_columns(
    df: DataFrame,
    actual: str = "z_score",
    predicted: str = "prediction",
    group: str = "position_group",
    keys: Sequence[str] = ("gsis_id", "season"),
) -> DataFrame:
    """Actual, predicted, error, absolute error and group of each row."""
    error = F.col(actual) - F.col(predicted)
    return df.select(
        *keys,
        F.col(actual).alias("actual"),
        F.col(predicted).alias("predicted"),
        error.alias("error"),
        F.abs(error).alias("abs_error"),
        F.col(group).alias("position"),
    )


def error_summary(df: DataFrame, error: str = "error") -> DataFrame:
    return df.agg(
        F.avg(error).alias("mean_error"),
        F.avg(F.abs(F.col(error))).alias("mean_abs_error"),
        F.stddev_samp(error).alias("std_error"),
    )


def metric_columns(actual: str, predicted: str, prefix: str = "") -> list[Column]:
    """R2, RMSE and MAE as aggregates of one pass.

    The target's sum of squares is taken over the rows that have a prediction.
    """
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    y = F.when(both, F.col(actual))
    error = y - F.col(predicted)
    squares = F.avg(error * error)
    return [
        (F.lit(1.0) - F.try_divide(squares, F.var_pop(y))).alias(f"{prefix}r2"),
        F.sqrt(squares).alias(f"{prefix}rmse"),
        F.avg(F.abs(error)).alias(f"{prefix}mae"),
    ]


def regression_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    return df.agg(*metric_columns(actual, predicted))
