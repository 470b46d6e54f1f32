"""Window features (W1-W11) and the move detection.

Windows are per entity over the aggregated table, where an entity has at most
one row per (season, group) however many events it has, so no window
partition grows with the event table. Columns that share a window
specification share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crossfade.functions.exprs import GROUPS, ordinal
from crossfade.operators.filters import require
from crossfade.operators.joins import attach
from crossfade.sources.staging import Stager, unstaged


def entity_window(
    entity: str = "gsis_id",
    time: str = "season",
    group: str | None = "position_group",
    group_order: Sequence[str] = GROUPS,
) -> WindowSpec:
    """Rows of one entity by season, groups of one season in a fixed order."""
    order = [F.col(time)]
    if group is not None:
        order.append(ordinal(group, group_order))
    return Window.partitionBy(entity).orderBy(*order)


def _known(entity: str, value: Column) -> Column:
    """NULL for rows without an entity: they form no group."""
    return F.when(F.col(entity).isNotNull(), value)


def _own_window(df: DataFrame, entity: str, metric: str, time: str = "season", group: str = "position_group") -> WindowSpec:
    """:func:`entity_window`, with the rows that have no entity dealt out by their values.

    They get NULL and need no window, but without more keys they would all meet
    in one task. Each call has an exchange of its own; features over rows that
    all have an entity share one if they are given an :func:`entity_window`.
    """
    own = [c for c in (time, group, "volume", "team") if c in df.columns]
    order = [F.col(time)] + ([ordinal(group, GROUPS)] if group in df.columns else [])
    apart = F.when(F.col(entity).isNull(), F.xxhash64(metric, *own))
    return Window.partitionBy(entity, apart).orderBy(*order)


def zscore_by_season_group(
    df: DataFrame,
    partition_by: Sequence[str] = ("season", "position_group"),
    metric: str = "metric_raw",
    stage: Stager = unstaged,
) -> DataFrame:
    """Cohort mean, sample deviation and z-score.

    A cohort can hold a third of all rows, so its statistics come from a
    partially combined aggregate and are joined back; a window would pass the
    whole cohort through one task. With ``stage`` the statistics are written
    first: the join then knows their size and leaves the rows where they are.
    """
    require(df, metric, *partition_by)
    stats = df.groupBy(*partition_by).agg(
        F.avg(metric).alias("mean_season"), F.stddev_samp(metric).alias("sd_season")
    )
    z = F.try_divide(F.col(metric) - F.col("mean_season"), F.col("sd_season"))
    return attach(df, stage(stats, "cohorts"), partition_by).withColumn("z_score", z)


def prev_team(
    df: DataFrame, unit: str = "team", window: WindowSpec | None = None
) -> DataFrame:
    """Unit of the entity's previous row, however long ago."""
    return df.withColumn("prev_team", F.lag(unit).over(window or entity_window()))


def team_change_flag(
    df: DataFrame, unit: str = "team", previous: str = "prev_team"
) -> DataFrame:
    """1 where the unit differs from a known previous one."""
    moved = F.col(previous).isNotNull() & (F.col(unit) != F.col(previous))
    return df.withColumn("changed_team", F.when(moved, 1).otherwise(0))


def cumulative_moves(
    df: DataFrame, flag: str = "changed_team", window: WindowSpec | None = None
) -> DataFrame:
    """Number of moves up to and including the row."""
    running = (window or entity_window()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("years_since_change", F.sum(flag).over(running))


def detect_moves(
    df: DataFrame,
    entity: str = "gsis_id",
    time: str = "season",
    group: str = "position_group",
) -> DataFrame:
    """Previous unit, change flag and running count in one sorted pass.

    The group ordinal is made a column first: two windows over the same column
    share a sort, two windows over the same expression would not.
    """
    window = Window.partitionBy(entity).orderBy(time, "_ordinal")
    ordered = df.withColumn("_ordinal", ordinal(group))
    flagged = team_change_flag(prev_team(ordered, window=window))
    return cumulative_moves(flagged, window=window).drop("_ordinal")


def first_transition(
    moves: DataFrame,
    min_experience: int = 3,
    entity: str = "gsis_id",
    time: str = "season",
    unit: str = "team",
    group: str = "position_group",
) -> DataFrame:
    """The first qualifying move of each entity, one row per entity."""
    qualifying = moves.filter(
        (F.col("changed_team") == 1) & (F.col("years_exp") >= min_experience)
    )
    rank = F.row_number().over(entity_window(entity, time, group))
    return (
        qualifying.withColumn("_rank", rank)
        .filter(F.col("_rank") == 1)
        .select(
            entity,
            F.col(time).alias(f"transition_{time}"),
            F.col(unit).alias(f"new_{unit}"),
        )
    )


def with_first_transition(
    moves: DataFrame,
    min_experience: int = 3,
    entity: str = "gsis_id",
    time: str = "season",
    unit: str = "team",
    group: str = "position_group",
) -> DataFrame:
    """``first_transition`` joined to all rows of its entity, without a join.

    The first move is a window minimum over the partition ``detect_moves`` has
    built, so no further shuffle is needed. Entities without one are dropped.
    """
    key = F.struct(
        F.col(time).alias("t"), ordinal(group).alias("o"), F.col(unit).alias("u")
    )
    qualifies = (F.col("changed_team") == 1) & (F.col("years_exp") >= min_experience)
    first = F.min(F.when(qualifies, key)).over(Window.partitionBy(entity))
    return (
        moves.withColumn("_first", first)
        .filter(F.col("_first").isNotNull())
        .withColumn(f"transition_{time}", F.col("_first.t"))
        .withColumn(f"new_{unit}", F.col("_first.u"))
        .drop("_first")
    )


def rolling_mean(
    df: DataFrame,
    width: int,
    metric: str = "z_score",
    entity: str = "gsis_id",
    window: WindowSpec | None = None,
) -> DataFrame:
    """Mean of the row and the ``width - 1`` rows before it."""
    frame = (window or _own_window(df, entity, metric)).rowsBetween(1 - width, 0)
    value = F.avg(metric).over(frame)
    return df.withColumn(f"{metric}_roll{width}", _known(entity, value))


def rolling_volatility(
    df: DataFrame,
    width: int,
    metric: str = "z_score",
    entity: str = "gsis_id",
    window: WindowSpec | None = None,
) -> DataFrame:
    """Sample deviation over the same frame; NULL for one value."""
    frame = (window or _own_window(df, entity, metric)).rowsBetween(1 - width, 0)
    value = F.stddev_samp(metric).over(frame)
    return df.withColumn(f"{metric}_vol{width}", _known(entity, value))


def momentum(
    df: DataFrame,
    metric: str = "z_score",
    entity: str = "gsis_id",
    window: WindowSpec | None = None,
) -> DataFrame:
    """Difference from the entity's previous row."""
    value = F.col(metric) - F.lag(metric).over(window or _own_window(df, entity, metric))
    return df.withColumn(f"{metric}_momentum", _known(entity, value))


def acceleration(
    df: DataFrame,
    metric: str = "z_score",
    entity: str = "gsis_id",
    window: WindowSpec | None = None,
) -> DataFrame:
    """Difference of the momentum column, which must be there."""
    source = f"{metric}_momentum"
    require(df, source)
    value = F.col(source) - F.lag(source).over(window or _own_window(df, entity, metric))
    return df.withColumn(f"{metric}_acceleration", _known(entity, value))


def cumulative_change(
    df: DataFrame,
    metric: str = "z_score",
    entity: str = "gsis_id",
    window: WindowSpec | None = None,
) -> DataFrame:
    """Difference from the entity's first row; NULL if that one is missing."""
    running = (window or _own_window(df, entity, metric)).rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(metric) - F.first(metric).over(running)
    return df.withColumn(f"{metric}_cumulative_change", _known(entity, value))


def entity_volatility(
    df: DataFrame, metric: str = "z_score", entity: str = "gsis_id"
) -> DataFrame:
    """The entity's sample deviation on each of its rows."""
    apart = F.when(F.col(entity).isNull(), F.xxhash64(*df.columns))
    value = F.stddev_samp(metric).over(Window.partitionBy(entity, apart))
    return df.withColumn("performance_variance", _known(entity, value))
