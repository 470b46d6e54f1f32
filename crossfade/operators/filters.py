"""Filters and projections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns kept from the event table, and those that are
# never model features.
EVENT_COLUMNS = (
    "play_id", "game_id", "season", "home_team", "away_team", "posteam", "defteam",
    "play_type", "yards_gained", "epa", "success", "air_yards", "yards_after_catch",
    "passer_player_id", "rusher_player_id", "receiver_player_id", "pass_attempt",
    "rush_attempt", "sack", "qb_hit",
)
SCALING_EXCLUDED = (
    "gsis_id", "season", "position_group", "team", "prev_team", "new_team",
    "changed_team", "post_transition", "phase", "rel_time", "years_since_change",
    "transition_season", "performance_level", "career_phase",
)
FEATURE_EXCLUDED = SCALING_EXCLUDED + (
    "exp_group", "adjustment_phase", "pre_trend_category", "data_split",
)
MODEL_EXCLUDED = FEATURE_EXCLUDED + ("volume",)


def require(df: DataFrame, *columns: str) -> None:
    """Raise when a column the operator needs is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")


def filter_regular(
    events: DataFrame,
    season_type: str = "REG",
    value: str = "epa",
    columns: Sequence[str] = EVENT_COLUMNS,
) -> DataFrame:
    """Events of one season type that carry a value, needed columns only."""
    require(events, "season_type", value, *columns)
    keep = (F.col("season_type") == season_type) & F.col(value).isNotNull()
    return events.filter(keep).select(*columns)


def filter_role(
    events: DataFrame, attempts: Sequence[str], player_id: str
) -> DataFrame:
    """Events with any of the attempt flags set and a known player."""
    require(events, player_id, *attempts)
    return events.filter(role_condition(attempts, player_id))


def role_condition(attempts: Sequence[str], player_id: str) -> Column:
    any_attempt = F.lit(False)
    for flag in attempts:
        any_attempt = any_attempt | (F.col(flag) == 1)
    return any_attempt & F.col(player_id).isNotNull()


def having_min_volume(
    df: DataFrame, minimum: int, volume: str = "volume"
) -> DataFrame:
    """Groups with at least ``minimum`` events."""
    return df.filter(F.col(volume) >= minimum)


def project_role(
    df: DataFrame,
    label: str,
    player_id: str,
    entity: str = "gsis_id",
    group: str = "position_group",
) -> DataFrame:
    """Constant group label, and the role's id column under the common name."""
    return df.withColumn(group, F.lit(label)).withColumnRenamed(player_id, entity)


def filter_window_band(
    panel: DataFrame, low: int = -2, high: int = 2, rel: str = "rel_time"
) -> DataFrame:
    return panel.filter(F.col(rel).between(low, high))


def filter_veteran_moves(
    moves: DataFrame,
    min_experience: int = 3,
    entity: str = "gsis_id",
    time: str = "season",
    unit: str = "team",
    experience: str = "years_exp",
    flag: str = "changed_team",
) -> DataFrame:
    """Moves of entities with enough experience."""
    require(moves, entity, time, unit, experience, flag)
    return moves.filter(
        (F.col(flag) == 1) & (F.col(experience) >= min_experience)
    ).select(
        entity,
        F.col(time).alias(f"transition_{time}"),
        F.col(unit).alias(f"new_{unit}"),
    )


def filter_isin(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """String columns in schema order."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def select_numeric_features(
    df: DataFrame,
    exclude: Iterable[str] = MODEL_EXCLUDED,
    target: str = "z_score",
) -> DataFrame:
    """Numeric columns other than the excluded ones and the target."""
    return df.select(*numeric_columns(df, [*exclude, target]))


def transition_events(
    panel: DataFrame,
    entity: str = "gsis_id",
    time: str = "season",
    flag: str = "changed_team",
    columns: Sequence[str] = (
        "position_group", "prev_team", "new_team", "metric_raw", "z_score",
    ),
) -> DataFrame:
    """Rows in which the unit changed, sorted by entity and time."""
    require(panel, entity, time, flag, *columns)
    return (
        panel.filter(F.col(flag) == 1)
        .select(entity, time, *columns)
        .orderBy(entity, time, *columns[:1])
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, and the rows and values it holds."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"v_{c}") for c in df.columns]
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.col("n").alias("n_rows"),
            F.col(f"v_{name}").alias("n_values"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns of each data type."""
    kinds = F.array(*[F.lit(kind) for _, kind in df.dtypes])
    kind = df.sparkSession.range(1).select(F.explode(kinds).alias("data_type"))
    return kind.groupBy("data_type").agg(F.count(F.lit(1)).alias("n_columns"))


def sample_head(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First rows of an explicit order (a top-k, not a full sort)."""
    return df.orderBy(*order_by).limit(n)


def sort_entity_season(
    df: DataFrame,
    entity: str = "gsis_id",
    time: str = "season",
    tie_break: Sequence[Column | str] = ("position_group",),
) -> DataFrame:
    """Total order for a sink."""
    return df.orderBy(entity, time, *tie_break)
