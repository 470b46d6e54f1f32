"""Profiling aggregates (A8-A17, A26, S9, M9): one pass per report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfade.operators.filters import numeric_columns, require
from crossfade.operators.quantiles import quantiles

_STATISTICS = {
    "mean": F.avg,
    "sum": F.sum,
    "std": F.stddev_samp,
    "count": F.count,
}


def _grouped_summary(
    df: DataFrame, keys: Sequence[str], statistics: Sequence[str], columns
) -> DataFrame:
    require(df, *keys)
    columns = columns or numeric_columns(df)
    known = df.dropna(subset=list(keys))
    aggregates = [
        _STATISTICS[s](c).alias(f"{c}_{s}") for c in columns for s in statistics
    ]
    return known.groupBy(*keys).agg(*aggregates)


def entity_season_summary(
    df: DataFrame,
    keys: Sequence[str] = ("gsis_id", "season"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Mean, sum, deviation and count of every numeric column."""
    return _grouped_summary(df, keys, ("mean", "sum", "std", "count"), columns)


def team_season_summary(
    df: DataFrame,
    keys: Sequence[str] = ("team", "season"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Mean, sum and deviation of every numeric column."""
    return _grouped_summary(df, keys, ("mean", "sum", "std"), columns)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each known value, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def value_counts_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequencies of the known values of several columns, from one pass."""
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    rows = df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
    return rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _unpivoted(row: DataFrame, columns: Sequence[str], **measures) -> DataFrame:
    """A one-row aggregate turned into one row per column.

    ``measures`` maps an output name to ``column name -> Column``.
    """
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[measure(c).alias(name) for name, measure in measures.items()],
        )
        for c in columns
    ]
    return row.select(F.inline(F.array(*entries)))


#: Digits of a double that outlast sums in another order.
SIGNIFICANT = 11


def _told_apart(df: DataFrame, column: str, places: int | None) -> Column:
    """The column; a double rounded to ``places``, if given, and -0.0 as 0.0.

    Sums of the same doubles in another order differ in their last bits, which
    would count as values of their own. Larger numbers, whose noise is larger,
    keep no more than ``SIGNIFICANT`` digits.
    """
    if places is None or dict(df.dtypes)[column] not in ("double", "float"):
        return F.col(column)
    value = F.round(column, places)
    for k in range(1, 13):
        large = F.abs(F.col(column)) >= 10.0 ** (SIGNIFICANT - places + k - 1)
        value = F.when(large, F.round(column, places - k)).otherwise(value)
    return value + F.lit(0.0)


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, places: int | None = None
) -> DataFrame:
    """Distinct known values per column; sketches when ``exact`` is False.

    With ``places`` doubles equal to so many decimal places, or to eleven digits, are one value.
    """
    columns = list(columns or df.columns)
    count = F.count_distinct if exact else F.approx_count_distinct
    row = df.agg(*[count(_told_apart(df, c, places)).alias(f"d_{c}") for c in columns])
    return _unpivoted(row, columns, n_distinct=lambda c: F.col(f"d_{c}"))


def describe_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact: bool = True,
    **options,
) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum per column."""
    columns = list(columns or numeric_columns(df))
    moments = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(f"m_{c}")
            for c in columns
        ]
    )
    quarters = quantiles(df, columns, [0.25, 0.5, 0.75], exact=exact, **options)
    fields = lambda name: lambda c: F.col(f"m_{c}")[name]
    left = _unpivoted(
        moments, columns, **{n: fields(n) for n in ("n", "mean", "std", "min", "max")}
    )
    right = _unpivoted(
        quarters,
        columns,
        **{q: (lambda i: lambda c: F.col(c)[i])(i) for i, q in enumerate(("q25", "q50", "q75"))},
    )
    return left.join(right, "column_name")


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing values per column that has any, most first."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"x_{c}") for c in df.columns],
    )
    return (
        _unpivoted(
            row,
            df.columns,
            missing_count=lambda c: F.col(f"x_{c}"),
            missing_pct=lambda c: F.round(F.col(f"x_{c}") / F.col("n") * 100, 2),
        )
        .filter(F.col("missing_count") > 0)
        .orderBy(F.desc("missing_count"), "column_name")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row; NULLs are equal."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def any_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def rows_with_nulls(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(any_null(df.columns)).alias("n_rows_with_nulls"))


def completeness(df: DataFrame) -> DataFrame:
    """Rows without a NULL, and the percentage of known cells."""
    cells = sum((F.count(c) for c in df.columns), F.lit(0))
    total = F.count(F.lit(1)) * len(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~any_null(df.columns)).alias("complete_rows"),
        (F.try_divide(cells, total) * 100).alias("completeness_pct"),
    )


def season_range(df: DataFrame, time: str = "season") -> DataFrame:
    return df.agg(
        F.min(time).alias("first_season"),
        F.max(time).alias("last_season"),
        F.count_distinct(time).alias("n_seasons"),
    )


def transition_summary(
    panel: DataFrame,
    entity: str = "gsis_id",
    group: str = "position_group",
    flag: str = "changed_team",
) -> DataFrame:
    """Move events: in total, by distinct entity, and by group.

    Entities are first reduced to one row each, with a count per group, so the
    distinct count needs no second pass.
    """
    events = panel.filter(F.col(flag) == 1)
    by_group = events.groupBy(group).agg(F.count(F.lit(1)).alias("n_events"))
    per_entity = events.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    total = per_entity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"),
        F.count(entity).alias("n_entities"),
    )
    return total.select(F.lit("all").alias("scope"), "n_events", "n_entities").unionByName(
        by_group.select(
            F.col(group).alias("scope"), "n_events", F.lit(None).cast("long").alias("n_entities")
        )
    )


def quality_report(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicates, and missing values per column.

    Grouping by all columns first gives the duplicates; all other figures
    follow from the groups and their sizes.
    """
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    missing = [
        F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"missing_{c}")
        for c in df.columns
    ]
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        *missing,
    )


def feature_metadata(df: DataFrame, exact: bool = True, places: int | None = None) -> DataFrame:
    """Type, missing percentage and distinct values of each column; ``places`` as in :func:`distinct_counts`."""
    count = F.count_distinct if exact else F.approx_count_distinct
    types = dict(df.dtypes)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"v_{c}") for c in df.columns],
        *[count(_told_apart(df, c, places)).alias(f"d_{c}") for c in df.columns],
    )
    return _unpivoted(
        row,
        df.columns,
        data_type=lambda c: F.lit(types[c]),
        missing_pct=lambda c: F.try_divide(F.col("n") - F.col(f"v_{c}"), F.col("n")) * 100,
        n_distinct=lambda c: F.col(f"d_{c}"),
    )
