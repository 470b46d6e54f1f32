"""Joins (J1-J9).

No join carries a broadcast hint. A side is broadcast when its size is known
to be small: from its files if it is a stage table, else from adaptive
execution, which measures a side once its stage has run. A larger side stays a
sort-merge join whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfade.operators.filters import require


def attach(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on same-named keys in which NULL equals NULL.

    The tables joined here are group aggregates, where a missing key is a
    group of its own; it has to find its rows again.
    """
    require(left, *on)
    require(right, *on)
    twice = [c for c in right.columns if c not in on and c in left.columns]
    if twice:
        raise ValueError(f"columns on both sides: {', '.join(twice)}")
    a, b = left.alias("a"), right.alias("b")
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in on]
    added = [F.col(f"b.{c}") for c in right.columns if c not in on]
    return a.join(b, match, how).select("a.*", *added)


def join_roster_left(
    base: DataFrame, roster: DataFrame, on: Sequence[str] = ("gsis_id", "season")
) -> DataFrame:
    """Attach the dimension; several roster rows for a key give several rows."""
    return base.join(roster, list(on), "left")


def join_first_transition(
    moves: DataFrame, events: DataFrame, entity: str = "gsis_id"
) -> DataFrame:
    """Rows of entities that have an event row, with that row's columns."""
    return moves.join(events, entity, "inner")


def join_team_pos_avg(
    panel: DataFrame,
    averages: DataFrame,
    on: Sequence[str] = ("team", "season", "position_group"),
) -> DataFrame:
    return attach(panel, averages, on)


def join_team_offense(
    panel: DataFrame,
    offense: DataFrame,
    unit: str = "team",
    offense_unit: str = "posteam",
    time: str = "season",
) -> DataFrame:
    """Left join in which the unit has another name on the right."""
    return attach(panel, offense.withColumnRenamed(offense_unit, unit), [unit, time])


def join_pre_trend(
    panel: DataFrame, trends: DataFrame, entity: str = "gsis_id"
) -> DataFrame:
    """Left join on the entity; NULL for one without earlier rows."""
    return panel.join(trends, entity, "left")


def join_distinct_effects(
    panel: DataFrame,
    effects: DataFrame,
    entity: str = "gsis_id",
    slope: str = "pre_trend_slope",
) -> DataFrame:
    """Distinct (entity, slope) with the entity's random effects."""
    return panel.select(entity, slope).distinct().join(effects, entity, "inner")


def join_back_aggregate(
    df: DataFrame,
    statistics: DataFrame,
    on: str,
    value: str,
    default: Column | float,
) -> DataFrame:
    """A per-category statistic on every row, ``default`` where there is none."""
    default = default if isinstance(default, Column) else F.lit(default)
    joined = df.join(statistics.select(on, value), on, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), default))


def semi_holdout(
    df: DataFrame, held_out: DataFrame, entity: str = "gsis_id"
) -> DataFrame:
    """Rows of the held-out entities."""
    return df.join(held_out, entity, "left_semi")


def anti_holdout(
    df: DataFrame, held_out: DataFrame, entity: str = "gsis_id"
) -> DataFrame:
    """Rows of all other entities."""
    return df.join(held_out, entity, "left_anti")
