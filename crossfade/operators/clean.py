"""Imputation, outliers, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfade.functions.exprs import clip
from crossfade.operators.filters import numeric_columns, require, string_columns
from crossfade.operators.joins import attach
from crossfade.operators.quantiles import medians, quantiles
from crossfade.sources.staging import Stager, unstaged


def group_median(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("position_group",), **options
) -> DataFrame:
    return medians(df, columns, by, **options)


def global_median(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    return medians(df, columns, **options)


def fit_group_median(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    group: str = "position_group",
    fallback_group: str = "team",
    stage: Stager = unstaged,
    **options,
) -> DataFrame:
    """Medians by group, with a row for each and a column ``_median_<c>`` per column.

    Without a group column the fallback group is used, without that the
    whole column is one group. With ``stage`` the medians are written.
    """
    columns = list(columns or numeric_columns(df))
    by = [g for g in (group, fallback_group) if g in df.columns][:1]
    middle = group_median(df, columns, by, **options)
    return stage(middle.select(*by, *[F.col(c).alias(f"_median_{c}") for c in columns]), "medians")


def apply_group_median(df: DataFrame, middle: DataFrame) -> DataFrame:
    """Fill missing numbers with the fitted median of the row's group.

    A group without any value, or one that was not there at the fit, stays
    missing. A filled column is a double.
    """
    by = [c for c in middle.columns if not c.startswith("_median_")]
    columns = [c.removeprefix("_median_") for c in middle.columns if c not in by]
    if not by:
        row = middle.first()
        return df.select(*_filled(df, columns, lambda c: F.lit(row[f"_median_{c}"])))
    joined = attach(df, middle, by)
    return joined.select(*_filled(df, columns, lambda c: F.col(f"_median_{c}")))


def impute_group_median(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    group: str = "position_group",
    fallback_group: str = "team",
    stage: Stager = unstaged,
    **options,
) -> DataFrame:
    """Fill missing numbers with the median of the row's group in the same table."""
    return apply_group_median(df, fit_group_median(df, columns, group, fallback_group, stage, **options))


def impute_global_median(
    df: DataFrame, columns: Sequence[str] | None = None, **options
) -> DataFrame:
    """Fill missing numbers with the median of the whole column."""
    columns = list(columns or numeric_columns(df))
    middle = global_median(df, columns, **options).first()
    return df.select(*_filled(df, columns, lambda c: F.lit(middle[c])))


def _filled(df: DataFrame, columns: Sequence[str], value) -> list:
    """All columns in order; the chosen ones filled."""
    chosen = set(columns)
    return [
        F.coalesce(F.col(c), value(c)).alias(c) if c in chosen else F.col(c)
        for c in df.columns
    ]


def column_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent known value per column, the smallest on ties.

    Counts per value are a partially combined aggregate; only one candidate
    per column and task takes part in the final step.
    """
    columns = list(columns or string_columns(df))
    require(df, *columns)
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    counts = (
        df.select(F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    return counts.groupBy("column_name").agg(best.alias("best")).select(
        "column_name", F.col("best.value").alias("mode"), (-F.col("best.neg")).alias("n")
    )


def impute_mode(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    default: str = "Unknown",
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Fill missing strings with the column's mode, or ``default`` if it has none.

    ``fit_on`` may name the rows to take the modes from: a stored table, say,
    of which ``df`` is a costly derivation with the same string columns.
    """
    columns = list(columns or string_columns(df))
    source = df if fit_on is None else fit_on
    modes = {r["column_name"]: r["mode"] for r in column_mode(source, columns).collect()}
    return df.fillna({c: modes.get(c, default) for c in columns})


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def distinct_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def distinct_entities(df: DataFrame, entity: str = "gsis_id") -> DataFrame:
    return df.select(entity).distinct()


def quartile_fences(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    width: float = 3.0,
    **options,
) -> DataFrame:
    """Quartiles and fences per column, one row each."""
    columns = list(columns or numeric_columns(df))
    quarters = quantiles(df, columns, [0.25, 0.75], **options)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(c)[0].alias("q1"), F.col(c)[1].alias("q3")
        )
        for c in columns
    ]
    spread = F.col("q3") - F.col("q1")
    return quarters.select(F.inline(F.array(*rows))).select(
        "column_name",
        "q1",
        "q3",
        (F.col("q1") - width * spread).alias("lower_fence"),
        (F.col("q3") + width * spread).alias("upper_fence"),
    )


def fences(q1: float, q3: float, width: float = 3.0) -> tuple[float, float]:
    """Bounds at ``width`` interquartile ranges outside the quartiles."""
    return q1 - width * (q3 - q1), q3 + width * (q3 - q1)


def fence_bounds(table: DataFrame) -> dict[str, tuple[float, float]]:
    """The fences as literals: one row per column of the table."""
    return {
        r["column_name"]: (r["lower_fence"], r["upper_fence"])
        for r in table.collect()
        if r["lower_fence"] is not None
    }


def clip_outliers(
    df: DataFrame, bounds: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """Cap the given columns at their bounds; NULL stays NULL."""
    return df.select(
        *[
            clip(F.col(c).cast("double"), *bounds[c]).alias(c) if c in bounds else F.col(c)
            for c in df.columns
        ]
    )


def capped_outlier_counts(
    df: DataFrame, bounds: Mapping[str, tuple[float, float]], top: int = 5
) -> DataFrame:
    """Rows outside the fences per column that has any, the most first."""
    outside = {
        c: F.count_if((F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high)))
        for c, (low, high) in bounds.items()
    }
    row = df.agg(*[n.alias(c) for c, n in outside.items()])
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_outliers")) for c in outside
    ]
    return (
        row.select(F.inline(F.array(*entries)))
        .filter(F.col("n_outliers") > 0)
        .orderBy(F.desc("n_outliers"), "column_name")
        .limit(top)
    )


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))
