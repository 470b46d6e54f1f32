"""Event aggregates (A1-A6) and their union."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfade.operators.filters import (
    filter_role,
    having_min_volume,
    project_role,
    require,
    role_condition,
)

EVENT_ORDER = ("game_id", "play_id")


def last_by(value: str, order_by: Sequence[str] = EVENT_ORDER) -> Column:
    """Value at the greatest order key, NULL included.

    One maximum over (key, value): it combines map-side, does not depend on
    row order as ``last`` after a shuffle would, and is cheaper than ``max_by``,
    which keeps two buffers. Equal keys give the greatest value.
    """
    return F.max(F.struct(*order_by, value))[value]


def _fixed_width(df: DataFrame, column: str) -> bool:
    """Whether a maximum of the column fits a hash aggregation buffer."""
    kinds = (T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return isinstance(df.schema[column].dataType, kinds)


VALUES = ("yards_gained", "epa", "success")
UNIT_VALUES = (*VALUES, "sack")


def _mean(value: str) -> Column:
    return F.try_divide(F.col(f"sum_{value}"), F.col(f"n_{value}"))


# The metric definitions a role may use, from sums and counts of its events.
METRICS = {
    # mean over known values
    "mean_yards": lambda: _mean("yards_gained"),
    # sum over known values by the count of all events
    "yards_per_event": lambda: F.coalesce(F.col("sum_yards_gained"), F.lit(0.0)) / F.col("volume"),
    "mean_epa": lambda: _mean("epa"),
}
EXTRAS = {
    "success_rate": lambda: _mean("success"),
    "metric_secondary": lambda: _mean("success"),
    "total_epa": lambda: F.coalesce(F.col("sum_epa"), F.lit(0.0)),
}


def _unit_sums(
    events: DataFrame,
    keys: Sequence[str],
    unit: str,
    order_by: Sequence[str] = EVENT_ORDER,
    values: Sequence[str] = VALUES,
) -> DataFrame:
    """Volume, sums and counts by ``keys``, unit and all of the order but its last part.

    Of that part the greatest is kept, a plain value: a string or a struct in
    an aggregation buffer would make Spark sort the events.
    """
    sums = [
        F.count(F.lit(1)).alias("volume"),
        *[F.sum(v).alias(f"sum_{v}") for v in values],
        *[F.count(v).alias(f"n_{v}") for v in values],
    ]
    *first, last = order_by
    if _fixed_width(events, last):
        return events.groupBy(*keys, unit, *first).agg(*sums, F.max(last).alias(last))
    return events.groupBy(*keys, unit, *order_by).agg(*sums)


def _over_units(
    by_unit: DataFrame,
    keys: Sequence[str],
    unit: str,
    order_by: Sequence[str] = EVENT_ORDER,
    values: Sequence[str] = VALUES,
) -> DataFrame:
    """:func:`_unit_sums` reduced to ``keys``, and the unit of the last event as ``team``."""
    return by_unit.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _sum_names(values)], last_by(unit, order_by).alias("team")
    )


def _sum_names(values: Sequence[str] = VALUES) -> list[str]:
    return ["volume", *[f"{kind}_{v}" for kind in ("sum", "n") for v in values]]


def _by_unit(
    events: DataFrame, keys: Sequence[str], unit: str, order_by: Sequence[str] = EVENT_ORDER
) -> DataFrame:
    """Volume, sums and counts by ``keys``, and the unit of the last event as ``team``.

    The events are hash-aggregated by unit first (:func:`_unit_sums`). What is
    left, one row per key, unit and game, is reduced to the keys.
    """
    values = [v for v in VALUES if v in events.columns]
    by_unit = _unit_sums(events, keys, unit, order_by, values)
    return _over_units(by_unit, keys, unit, order_by, values)


@dataclass(frozen=True)
class Role:
    """How the events of one group are selected and summarised."""

    label: str
    player_id: str
    attempts: tuple[str, ...]
    metric: str
    min_volume: int
    extras: tuple[str, ...] = field(default=())


# The three roles and their minimum event counts.
RUSH = Role(
    "RB", "rusher_player_id", ("rush_attempt",), "mean_yards", 100,
    ("success_rate", "total_epa"),
)
TARGET = Role(
    "WR_TE", "receiver_player_id", ("pass_attempt",), "yards_per_event", 50,
    ("success_rate",),
)
PASS = Role(
    "QB", "passer_player_id", ("pass_attempt", "rush_attempt"), "mean_epa", 200,
    ("metric_secondary",),
)
ROLES = (RUSH, TARGET, PASS)


def efficiency(
    events: DataFrame,
    role: Role,
    time: str = "season",
    unit: str = "posteam",
    order_by: Sequence[str] = EVENT_ORDER,
) -> DataFrame:
    """One role's table: one row per (entity, season) with enough events."""
    require(events, time, unit, role.player_id, *order_by)
    rows = filter_role(events, role.attempts, role.player_id)
    grouped = _by_unit(rows, [role.player_id, time], unit, order_by)
    table = grouped.select(
        role.player_id,
        time,
        METRICS[role.metric]().alias("metric_raw"),
        "volume",
        *[EXTRAS[name]().alias(name) for name in role.extras],
        "team",
    )
    table = having_min_volume(table, role.min_volume)
    return project_role(table, role.label, role.player_id)


def rush_efficiency(events: DataFrame, role: Role = RUSH) -> DataFrame:
    return efficiency(events, role)


def target_efficiency(events: DataFrame, role: Role = TARGET) -> DataFrame:
    return efficiency(events, role)


def passer_efficiency(events: DataFrame, role: Role = PASS) -> DataFrame:
    return efficiency(events, role)


def last_team(
    events: DataFrame,
    keys: Sequence[str],
    unit: str = "posteam",
    order_by: Sequence[str] = EVENT_ORDER,
) -> DataFrame:
    """The unit of each key's last event; see :func:`_by_unit`."""
    return _by_unit(events, keys, unit, order_by).select(*keys, "team")


def union_positions(*tables: DataFrame) -> DataFrame:
    """Stack by column name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def role_metrics(
    events: DataFrame,
    roles: Sequence[Role] = ROLES,
    time: str = "season",
    unit: str = "posteam",
    order_by: Sequence[str] = EVENT_ORDER,
) -> DataFrame:
    """All role tables from one scan of the events.

    Every event is expanded to the (role, entity) pairs it counts for and the
    pairs are aggregated together. Equal to the union of ``efficiency`` over
    the roles, which would scan and shuffle the events once per role.

    Events are hash-aggregated; see :func:`_by_unit`.
    """
    require(events, time, unit, *order_by, *[r.player_id for r in roles])
    pairs = [
        F.struct(
            F.lit(r.label).alias("position_group"),
            F.when(role_condition(r.attempts, r.player_id), F.col(r.player_id)).alias("gsis_id"),
        )
        for r in roles
    ]
    # A plain array stays in generated code; a lambda to drop the empty pairs
    # before the expansion would not.
    expanded = events.select(
        time, unit, *order_by, *VALUES, F.inline(F.array(*pairs))
    ).filter(F.col("gsis_id").isNotNull())
    grouped = _by_unit(expanded, ("gsis_id", time, "position_group"), unit, order_by)
    return _role_table(grouped.filter(_enough(roles)), roles, time)


def _per_role(roles: Sequence[Role], pick, empty: Column) -> Column:
    """The value each role uses, ``empty`` for a role that has none."""
    out = empty
    for r in roles:
        value = pick(r)
        if value is not None:
            out = F.when(F.col("position_group") == r.label, value).otherwise(out)
    return out


def _enough(roles: Sequence[Role]) -> Column:
    return F.col("volume") >= _per_role(roles, lambda r: F.lit(r.min_volume), F.lit(None).cast("int"))


def _role_table(grouped: DataFrame, roles: Sequence[Role], time: str) -> DataFrame:
    """The roles' metrics from the sums of their events."""
    known = {name: make() for name, make in {**METRICS, **EXTRAS}.items()}
    nothing = F.lit(None).cast("double")
    extra = lambda name: _per_role(
        roles, lambda r: known[name] if name in r.extras else None, nothing
    )
    return grouped.select(
        "gsis_id",
        time,
        _per_role(roles, lambda r: known[r.metric], nothing).alias("metric_raw"),
        "volume",
        extra("success_rate").alias("success_rate"),
        extra("total_epa").alias("total_epa"),
        "team",
        "position_group",
        extra("metric_secondary").alias("metric_secondary"),
    )


def _entity(role: Role) -> str:
    return f"_entity_{role.label}"


def role_and_unit_sums(
    events: DataFrame,
    roles: Sequence[Role] = ROLES,
    time: str = "season",
    unit: str = "posteam",
    order_by: Sequence[str] = EVENT_ORDER,
) -> DataFrame:
    """Sums for :func:`role_table` and :func:`unit_table` from one scan.

    Events of the same entities (a column per role, NULL if the event does not
    count for it), season and unit are summed before they are expanded to the
    (role, entity) pairs and the units' sides they count for: an event is one
    row of the aggregation, whatever it counts for.
    """
    require(events, time, unit, *order_by, *[r.player_id for r in roles])
    kind = events.schema[roles[0].player_id].dataType
    entities = [
        F.when(role_condition(r.attempts, r.player_id), F.col(r.player_id)).cast(kind).alias(_entity(r)) for r in roles
    ]
    sides = [F.coalesce(F.col(f"{s}_attempt") == 1, F.lit(False)).alias(f"_{s}") for s in ("pass", "rush")]
    values = [F.col(v).cast("double").alias(v) for v in UNIT_VALUES]
    rows = events.select(time, unit, *order_by, *entities, *sides, *values)
    counts = F.col("_pass") | F.col("_rush")
    for r in roles:
        counts = counts | F.col(_entity(r)).isNotNull()
    keys = (time, *[_entity(r) for r in roles], "_pass", "_rush")
    return _unit_sums(rows.filter(counts), keys, unit, order_by, UNIT_VALUES)


def role_table(
    sums: DataFrame,
    roles: Sequence[Role] = ROLES,
    time: str = "season",
    unit: str = "posteam",
    order_by: Sequence[str] = EVENT_ORDER,
) -> DataFrame:
    """:func:`role_metrics` from :func:`role_and_unit_sums`."""
    pairs = [F.struct(F.lit(r.label).alias("position_group"), F.col(_entity(r)).alias("gsis_id")) for r in roles]
    expanded = sums.select(time, unit, *order_by, *_sum_names(), F.inline(F.array(*pairs)))
    keys = ("gsis_id", time, "position_group")
    grouped = _over_units(expanded.filter(F.col("gsis_id").isNotNull()), keys, unit, order_by)
    return _role_table(grouped.filter(_enough(roles)), roles, time)


def unit_table(sums: DataFrame, unit: str = "posteam", time: str = "season") -> DataFrame:
    """:func:`team_offense_context` from :func:`role_and_unit_sums`.

    A unit with neither passes nor rushes has no row instead of an empty one.
    """
    of = lambda side, v: F.try_divide(
        F.sum(F.when(F.col(side), F.col(f"sum_{v}"))), F.sum(F.when(F.col(side), F.col(f"n_{v}")))
    )
    return sums.filter(F.col("_pass") | F.col("_rush")).groupBy(unit, time).agg(
        of("_pass", "epa").alias("team_pass_epa_per_play"),
        of("_rush", "epa").alias("team_rush_epa_per_play"),
        of("_pass", "sack").alias("team_sack_rate"),
    )


def team_position_avg(
    base: DataFrame,
    unit: str = "team",
    time: str = "season",
    group: str = "position_group",
    metric: str = "z_score",
) -> DataFrame:
    """Mean metric by (unit, season, group); the entity itself is included."""
    return base.groupBy(unit, time, group).agg(F.avg(metric).alias("team_pos_avg"))


def team_offense_context(
    events: DataFrame, unit: str = "posteam", time: str = "season"
) -> DataFrame:
    """Conditional means of the unit's events in one aggregate."""
    passing = F.col("pass_attempt") == 1
    rushing = F.col("rush_attempt") == 1
    return events.groupBy(unit, time).agg(
        F.avg(F.when(passing, F.col("epa"))).alias("team_pass_epa_per_play"),
        F.avg(F.when(rushing, F.col("epa"))).alias("team_rush_epa_per_play"),
        F.avg(F.when(passing, F.col("sack"))).alias("team_sack_rate"),
    )
