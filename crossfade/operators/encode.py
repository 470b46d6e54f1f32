"""Scaling, encoding and reduction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfade.operators.filters import require
from crossfade.operators.joins import join_back_aggregate
from crossfade.operators.quantiles import medians
from crossfade.sources.staging import stage


# -- scaling ---------------------------------------------------------------


def fit_standardize(
    df: DataFrame,
    columns: Sequence[str],
    middle: Mapping[str, float] | None = None,
    **options,
) -> DataFrame:
    """Median, mean and deviation per column, one row each.

    Mean and population deviation are those of the column after its missing
    values were filled with the median; a constant column has deviation 1.
    ``middle`` gives medians that are known already.
    """
    middle = medians(df, columns, **options).first() if middle is None else middle
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(middle[c])) for c in columns]
    row = df.agg(
        *[
            F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd")).alias(c)
            for c, x in zip(columns, filled)
        ]
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(middle[c]).cast("double").alias("median"),
            F.col(c)["mean"].alias("mean"),
            F.when(F.col(c)["sd"] == 0, F.lit(1.0)).otherwise(F.col(c)["sd"]).alias("sd"),
        )
        for c in columns
    ]
    return row.select(F.inline(F.array(*entries)))


def apply_standardize(df: DataFrame, params: DataFrame) -> DataFrame:
    """Fill, centre and scale; the parameters hold one row per column."""
    fitted = {r["column_name"]: r for r in params.collect()}

    def scaled(c: str):
        r = fitted[c]
        value = F.coalesce(F.col(c).cast("double"), F.lit(r["median"]))
        return ((value - F.lit(r["mean"])) / F.lit(r["sd"])).alias(c)

    return df.select(*[scaled(c) if c in fitted else F.col(c) for c in df.columns])


def standardize(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    return apply_standardize(df, fit_standardize(df, columns, **options))


# -- categories ------------------------------------------------------------


def levels(df: DataFrame, column: str, limit: int = 15) -> list | None:
    """Sorted known values, or None when there are more than ``limit``."""
    seen = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1)
    values = sorted(r[0] for r in seen.collect())
    return values if len(values) <= limit else None


def append_dummy_columns(
    df: DataFrame, column: str, values: Sequence, prefix: str | None = None
) -> DataFrame:
    """One 0/1 column per value; NULL is 0 everywhere."""
    prefix = column if prefix is None else prefix
    hit = lambda v: F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int")
    return df.select("*", *[hit(v).alias(f"{prefix}_{v}") for v in values])


def one_hot(df: DataFrame, column: str, limit: int = 15) -> DataFrame:
    """Indicators of all sorted levels but the first."""
    values = levels(df, column, limit)
    if values is None:
        raise ValueError(f"{column} has more than {limit} values; use label_encode")
    return append_dummy_columns(df, column, values[1:])


def number_rows(df: DataFrame, order_by: Sequence, name: str = "index") -> DataFrame:
    """Consecutive numbers from 0 in a total order, without a one-task window.

    The rows are range-sorted and written with their position in the task's
    output; the offset of a task is the sum of the sizes before it, and there
    is one size per task however many rows there are.
    """
    ordered = stage(
        df.orderBy(*order_by).withColumn("_id", F.monotonically_increasing_id()), "ordered"
    )
    # monotonically_increasing_id: task number above bit 33, row number below
    ordered = ordered.withColumn("_task", F.shiftright("_id", 33)).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = ordered.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ordered.join(starts, "_task").select(
        *df.columns, (F.col("_start") + F.col("_row")).alias(name)
    )


def fit_label_encode(df: DataFrame, column: str, order_by: Sequence) -> DataFrame:
    """Code of each value by first appearance in the given order."""
    first = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min(F.struct(*order_by)).alias("_first"))
    )
    return number_rows(first, ["_first", column], "code").select(column, "code")


def apply_label_encode(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Fitted codes of a column; a missing or unknown value is -1."""
    codes = codes.withColumnRenamed("code", f"{column}_encoded")
    return join_back_aggregate(df, codes, column, f"{column}_encoded", F.lit(-1).cast("long"))


def label_encode(df: DataFrame, column: str, order_by: Sequence) -> DataFrame:
    """Integer codes by first appearance; a missing value is -1."""
    return apply_label_encode(df, fit_label_encode(df, column, order_by), column)


def fit_target_encode(
    df: DataFrame, column: str, target: str = "z_score", smoothing: float = 1.0
) -> tuple[DataFrame, float]:
    """Smoothed target mean per category, and the overall mean.

    Both come from the per-category sums, which are written once: one pass
    over the rows, and a join that knows the table's size.
    """
    require(df, column, target)
    groups = stage(
        df.groupBy(column).agg(F.count(target).alias("n"), F.sum(target).alias("total")),
        "categories",
    )
    row = groups.agg(F.try_divide(F.sum("total"), F.sum("n"))).first()
    overall = row[0]
    encoded = (
        F.coalesce(F.col("total"), F.lit(0.0)) + F.lit(smoothing) * F.lit(overall)
    ) / (F.col("n") + F.lit(smoothing))
    # A category without any target value has no mean: it gets the overall one.
    encoded = F.when(F.col("n") > 0, encoded).otherwise(F.lit(overall))
    table = groups.filter(F.col(column).isNotNull()).select(column, encoded.alias("encoded"))
    return table, overall


def target_encode(
    df: DataFrame,
    column: str,
    target: str = "z_score",
    smoothing: float = 1.0,
    out: str | None = None,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Smoothed target mean of the row's category.

    Fitted on ``df`` itself unless ``fit_on`` gives other rows (the training
    rows, say). A column that is not a string is passed through.
    """
    out = out or f"{column}_encoded"
    if dict(df.dtypes)[column] != "string":
        return df.withColumn(out, F.col(column))
    table, overall = fit_target_encode(df if fit_on is None else fit_on, column, target, smoothing)
    return join_back_aggregate(df, table.withColumnRenamed("encoded", out), column, out, F.lit(overall))


# -- reduction -------------------------------------------------------------


def fit_pca(df: DataFrame, columns: Sequence[str], k: int = 10, **options):
    """Standardisation parameters and a PCA model of the standardised columns."""
    params = fit_standardize(df, columns, **options)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(
        apply_standardize(df, params)
    )
    model = PCA(k=min(k, len(columns)), inputCol="features", outputCol="scores").fit(
        vectors.select("features")
    )
    return params, model


def _signs(model) -> list[float]:
    """+1 or -1 per component: the loading of largest size becomes positive."""
    loadings = model.pc.toArray()
    rows = abs(loadings).argmax(axis=0)
    return [1.0 if loadings[r, j] >= 0 else -1.0 for j, r in enumerate(rows)]


def pca_scores(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("gsis_id", "season"),
    k: int = 10,
    fitted=None,
) -> DataFrame:
    """Component scores next to the row's keys."""
    params, model = fitted or fit_pca(df, columns, k)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(
        apply_standardize(df, params)
    )
    scored = model.transform(vectors).withColumn("_s", vector_to_array("scores"))
    signs = _signs(model)
    return scored.select(
        *keys, *[(F.col("_s")[i] * s).alias(f"PC{i + 1}") for i, s in enumerate(signs)]
    )


def pca_explained_variance(spark, model) -> DataFrame:
    """Share and running share of variance per component (one row each)."""
    rows, total = [], 0.0
    for i, share in enumerate(model.explainedVariance.toArray()):
        total += float(share)
        rows.append((f"PC{i + 1}", float(share), total))
    return spark.createDataFrame(
        rows, "Component string, Explained_Variance double, Cumulative_Variance double"
    )


# -- orthogonal polynomial -------------------------------------------------


def fit_orthogonal_poly2(df: DataFrame, column: str) -> Mapping[str, float]:
    """Mean and central sums of a column: two one-row aggregates."""
    mean = df.agg(F.avg(column)).first()[0]
    c = F.col(column) - F.lit(mean)
    sums = df.agg(
        F.count(column).alias("n"),
        F.sum(c * c).alias("s2"),
        F.sum(c * c * c).alias("s3"),
        F.sum(c * c * c * c).alias("s4"),
    ).first()
    return {"mean": mean, **sums.asDict()}


def orthogonal_poly2(
    df: DataFrame,
    column: str = "age",
    fitted: Mapping[str, float] | None = None,
    out: Sequence[str] = ("age_poly1", "age_poly2"),
) -> DataFrame:
    """Orthonormal linear and quadratic terms of a column.

    A column needs three different values to have both.
    """
    p = fitted or fit_orthogonal_poly2(df, column)
    n, s2, s3, s4 = p["n"], p["s2"], p["s3"], p["s4"]
    left = s4 - s2 * s2 / n - s3 * s3 / s2 if n and s2 else 0.0
    if not left > 1e-12 * (s4 or 0.0):
        raise ValueError(f"{column} has fewer than three different values")
    c = F.col(column) - F.lit(p["mean"])
    size = left**0.5
    return df.withColumns(
        {
            out[0]: c / F.lit(s2**0.5),
            out[1]: (c * c - F.lit(s2 / n) - F.lit(s3 / s2) * c) / F.lit(size),
        }
    )
