"""Table readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("game_id", T.StringType()),
        T.StructField("play_id", T.LongType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("season_type", T.StringType()),
        T.StructField("home_team", T.StringType()),
        T.StructField("away_team", T.StringType()),
        T.StructField("posteam", T.StringType()),
        T.StructField("defteam", T.StringType()),
        T.StructField("play_type", T.StringType()),
        T.StructField("yards_gained", T.DoubleType()),
        T.StructField("epa", T.DoubleType()),
        T.StructField("success", T.DoubleType()),
        T.StructField("air_yards", T.DoubleType()),
        T.StructField("yards_after_catch", T.DoubleType()),
        T.StructField("passer_player_id", T.StringType()),
        T.StructField("rusher_player_id", T.StringType()),
        T.StructField("receiver_player_id", T.StringType()),
        T.StructField("pass_attempt", T.DoubleType()),
        T.StructField("rush_attempt", T.DoubleType()),
        T.StructField("sack", T.DoubleType()),
        T.StructField("qb_hit", T.DoubleType()),
    ]
)

ROSTER_SCHEMA = T.StructType(
    [
        T.StructField("gsis_id", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("years_exp", T.IntegerType()),
        T.StructField("birth_date", T.DateType()),
    ]
)

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("gsis_id", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("metric_raw", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("success_rate", T.DoubleType()),
        T.StructField("total_epa", T.DoubleType()),
        T.StructField("team", T.StringType()),
        T.StructField("position_group", T.StringType()),
        T.StructField("metric_secondary", T.DoubleType()),
        T.StructField("mean_season", T.DoubleType()),
        T.StructField("sd_season", T.DoubleType()),
        T.StructField("z_score", T.DoubleType()),
        T.StructField("years_exp", T.IntegerType()),
        T.StructField("age", T.DoubleType()),
        T.StructField("prev_team", T.StringType()),
        T.StructField("changed_team", T.IntegerType()),
        T.StructField("years_since_change", T.LongType()),
        T.StructField("transition_season", T.IntegerType()),
        T.StructField("new_team", T.StringType()),
        T.StructField("rel_time", T.IntegerType()),
        T.StructField("post_transition", T.IntegerType()),
        T.StructField("phase", T.StringType()),
        T.StructField("team_pos_avg", T.DoubleType()),
        T.StructField("team_quality", T.DoubleType()),
        T.StructField("team_pass_epa_per_play", T.DoubleType()),
        T.StructField("team_rush_epa_per_play", T.DoubleType()),
        T.StructField("team_sack_rate", T.DoubleType()),
        T.StructField("pre_trend_slope", T.DoubleType()),
    ]
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column: one notion of missing."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floats)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def scan_parquet(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    seasons: Iterable[int] | None = None,
) -> DataFrame:
    """Read a Parquet table; the season list becomes a pushed-down filter."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if seasons is None else df.filter(F.col("season").isin(list(seasons)))


def scan_events(
    spark: SparkSession, path: str, seasons: Iterable[int] | None = None
) -> DataFrame:
    """Event table, optionally for a list of seasons; NaN is NULL."""
    return nan_to_null(scan_parquet(spark, path, EVENT_SCHEMA, seasons))


def scan_roster(
    spark: SparkSession, path: str, seasons: Iterable[int] | None = None
) -> DataFrame:
    """Entity-season dimension; NaN is NULL."""
    return nan_to_null(scan_parquet(spark, path, ROSTER_SCHEMA, seasons))


def scan_panel_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Panel as Parquet."""
    return nan_to_null(scan_parquet(spark, path))


def scan_panel_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PANEL_SCHEMA,
    null_value: str = "NA",
) -> DataFrame:
    """Panel as CSV with a header and a text mark for missing values."""
    return nan_to_null(
        spark.read.csv(
            path, header=True, schema=schema, nullValue=null_value, enforceSchema=False
        )
    )
