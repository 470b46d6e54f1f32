"""From events to the panel in relative time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfade.functions import exprs as X
from crossfade.operators import filters, joins, metrics, windows
from crossfade.sources.scan import PANEL_SCHEMA
from crossfade.sources.staging import Stager, unstaged


def roster_with_age(roster: DataFrame) -> DataFrame:
    return roster.select(
        "gsis_id",
        "season",
        "years_exp",
        X.age_on_season_start("season", "birth_date").alias("age"),
    )


def base_metrics(
    events: DataFrame,
    roster: DataFrame,
    roles: Sequence[metrics.Role] = metrics.ROLES,
    stage: Stager = unstaged,
    order_by: Sequence[str] = metrics.EVENT_ORDER,
) -> DataFrame:
    """Entity-season metrics with z-scores, experience and age.

    The cohort statistics and the rows they go back to both need the
    aggregated events. ``stage`` writes that table (a small fraction of the
    events) so that the events are scanned for it once.
    """
    columns = dict.fromkeys([*filters.EVENT_COLUMNS, *order_by])
    regular = filters.filter_regular(events, columns=list(columns))
    table = stage(metrics.role_metrics(regular, roles, order_by=order_by), "metrics")
    scored = windows.zscore_by_season_group(table, stage=stage)
    return joins.join_roster_left(scored, roster_with_age(roster))


def base_and_offense(
    events: DataFrame,
    roster: DataFrame,
    roles: Sequence[metrics.Role] = metrics.ROLES,
    stage: Stager = unstaged,
    order_by: Sequence[str] = metrics.EVENT_ORDER,
) -> tuple[DataFrame, DataFrame]:
    """:func:`base_metrics` and the units' offense for :func:`build_panel`, from one scan of the events."""
    columns = dict.fromkeys([*filters.EVENT_COLUMNS, *order_by])
    regular = filters.filter_regular(events, columns=list(columns))
    sums = stage(metrics.role_and_unit_sums(regular, roles, order_by=order_by), "sums")
    table = stage(metrics.role_table(sums, roles, order_by=order_by), "metrics")
    scored = windows.zscore_by_season_group(table, stage=stage)
    return joins.join_roster_left(scored, roster_with_age(roster)), metrics.unit_table(sums)


def relative_panel(
    base: DataFrame, min_experience: int = 3, low: int = -2, high: int = 2
) -> DataFrame:
    """Moves, first qualifying move, relative time and pre-trend.

    Every window is per entity: one exchange and one sort serve them all.
    """
    moves = windows.detect_moves(base)
    timed = windows.with_first_transition(moves, min_experience)
    timed = timed.withColumn("rel_time", X.relative_time("season", "transition_season"))
    panel = filters.filter_window_band(timed, low, high)
    return panel.withColumn("post_transition", X.post_flag("rel_time")).withColumn(
        "phase", X.phase_label("rel_time")
    )


def pre_trend_slope(
    panel: DataFrame,
    entity: str = "gsis_id",
    rel: str = "rel_time",
    metric: str = "z_score",
) -> DataFrame:
    """Least-squares slope over the rows before the move; one point gives 0."""
    return (
        panel.filter(F.col(rel) < 0)
        .groupBy(entity)
        .agg(
            F.coalesce(F.regr_slope(metric, rel), F.lit(0.0)).alias("pre_trend_slope")
        )
    )


def with_pre_trend(
    panel: DataFrame,
    entity: str = "gsis_id",
    rel: str = "rel_time",
    metric: str = "z_score",
) -> DataFrame:
    """``pre_trend_slope`` on every row as a window over the entity.

    Equal to the aggregate and its left join, on the partitioning the panel
    already has. NULL for an entity without rows before the move.
    """
    per_entity = Window.partitionBy(entity)
    before = F.col(rel) < 0
    slope = X.trend_slope(metric, rel, before).over(per_entity)
    rows = F.count(F.when(before, 1)).over(per_entity)
    return panel.withColumn(
        "pre_trend_slope", F.when(rows > 0, F.coalesce(slope, F.lit(0.0)))
    )


def team_context(panel: DataFrame, averages: DataFrame, offense: DataFrame) -> DataFrame:
    """Team averages and the quality of the supporting cast."""
    panel = joins.join_team_pos_avg(panel, averages)
    panel = joins.join_team_offense(panel, offense)
    quality = X.team_quality(
        F.col("position_group"), F.col("team_pass_epa_per_play"), F.col("team_sack_rate")
    )
    return panel.withColumn("team_quality", quality)


def build_panel(
    events: DataFrame,
    base: DataFrame,
    min_experience: int = 3,
    stage: Stager = unstaged,
    offense: DataFrame | None = None,
) -> DataFrame:
    """The 28-column panel, in the order of ``PANEL_SCHEMA``.

    With ``stage`` the team tables (one row per team and season) are written
    before they are joined, so their size decides how. ``offense`` may give
    the units' context if it is known; the events are then not read again.
    """
    if offense is None:
        offense = stage(metrics.team_offense_context(filters.filter_regular(events)), "offense")
    averages = stage(metrics.team_position_avg(base), "averages")
    panel = with_pre_trend(relative_panel(base, min_experience))
    return team_context(panel, averages, offense).select(*PANEL_SCHEMA.names)


def transition_effect(panel: DataFrame) -> DataFrame:
    """Mean, spread and slope of the metric before and after the move, by group."""
    return panel.groupBy("position_group", "phase").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("z_score").alias("mean_z"),
        F.regr_slope("z_score", "rel_time").alias("slope_z"),
        F.stddev_samp("z_score").alias("sd_z"),
    )
