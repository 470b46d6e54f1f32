"""The driver's tables in the shape of the library's inputs.

``lineitem`` joined to ``orders`` plays the event table and ``supplier`` the
roster. Two variants: ``flags`` has three groups per entity and five units,
``single`` has one group per entity and two units. See FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfade.operators import metrics
from crossfade.plans import panel as P
from crossfade.sources.scan import PANEL_SCHEMA
from crossfade.sources.staging import stage

SEASONS = range(1995, 2002)
# Columns of the panel by use: all numbers but the season, all labels of moves, and what has few values.
MEASURES = tuple(
    f.name
    for f in PANEL_SCHEMA.fields
    if f.name != "season" and f.dataType.simpleString() != "string"
)
LABELS = ("team", "prev_team")
CATEGORIES = (
    "position_group", "team", "prev_team", "new_team", "phase", "season", "changed_team",
    "post_transition", "rel_time", "years_since_change", "transition_season",
)
# Not a round number: means of exact decimals could end in a 5 right after the
# last place kept, where two engines round to different sides.
EPA_SCALE = 1234.567
MIN_VOLUME = {"flags": (16, 12, 18), "single": (55, 50, 60)}


def roles(variant: str) -> tuple[metrics.Role, ...]:
    """The library's roles with minimum volumes that fit the small tables."""
    pairs = zip(metrics.ROLES, MIN_VOLUME[variant])
    return tuple(replace(role, min_volume=n) for role, n in pairs)


def events(
    spark: SparkSession,
    sf_dir: str,
    variant: str = "flags",
    seasons: Iterable[int] | None = None,
    numbered: bool = False,
) -> DataFrame:
    """One event per line item.

    With ``numbered`` a column ``event_number`` orders the events as
    ``(game_id, play_id)`` does, in one long: the day, a missing one first,
    above 41 bits of order key. Sums by unit then need no key for the game.

    A season list is also given to the scan as ship-date ranges, which reach
    the Parquet reader; a filter on the derived season would not.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus"
    )
    if seasons is not None:
        wanted = F.lit(False)
        for s in seasons:
            start, end = datetime(s, 1, 1), datetime(s + 1, 1, 1)
            wanted = wanted | (
                (F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
                & (F.col("l_shipdate") < F.lit(end).cast("timestamp_ntz"))
            )
        items = items.filter(wanted)
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if variant == "flags":
        role = F.col("l_returnflag")
        is_rush, is_target, is_pass = role == "R", role == "A", role == "N"
        unit = F.col("o_orderpriority")
    else:
        role = F.col("l_suppkey") % 3
        is_rush, is_target, is_pass = role == 0, role == 1, role == 2
        urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        unit = F.when(urgent, "HI").otherwise("LO")
    entity = F.col("l_suppkey").cast("string")
    number = lambda c: c.cast("double")
    day = F.coalesce(F.unix_date(F.to_date("l_shipdate")), F.lit(-(1 << 21))).cast("long")
    order = [(F.shiftleft(day, 41) + F.col("l_orderkey")).alias("event_number")] if numbered else []
    return joined.select(
        *order,
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("game_id"),
        F.col("l_orderkey").alias("play_id"),
        F.year("l_shipdate").cast("int").alias("season"),
        F.when(F.col("l_linenumber") == 7, "POST").otherwise("REG").alias("season_type"),
        unit.alias("home_team"),
        F.col("o_orderstatus").alias("away_team"),
        unit.alias("posteam"),
        F.col("o_orderstatus").alias("defteam"),
        F.when(is_rush, "run").otherwise("pass").alias("play_type"),
        F.when(F.col("l_quantity") != 50, F.col("l_quantity")).alias("yards_gained"),
        F.when(
            F.col("l_discount") != 0,
            F.col("l_extendedprice") * (1 - F.col("l_discount")) / EPA_SCALE,
        ).alias("epa"),
        number(F.col("l_discount") > 0.05).alias("success"),
        (F.col("l_quantity") * 0.5).alias("air_yards"),
        (F.col("l_quantity") * 0.25).alias("yards_after_catch"),
        F.when(is_pass, entity).alias("passer_player_id"),
        F.when(is_rush, entity).alias("rusher_player_id"),
        F.when(is_target, entity).alias("receiver_player_id"),
        number(~is_rush).alias("pass_attempt"),
        number(is_rush).alias("rush_attempt"),
        number(F.col("l_linestatus") == "F").alias("sack"),
        number(F.col("l_tax") > 0.04).alias("qb_hit"),
    )


def roster(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """One row per (supplier, season); with ``gaps`` some are missing, for the join."""
    missing = F.lit(gaps) & (
        (F.col("s_nationkey") == 24)
        | ((F.col("s_nationkey") % 10 == 3) & (F.col("season") == 1997))
    )
    nation, balance = F.col("s_nationkey"), F.col("s_acctbal")
    years = F.sequence(F.lit(SEASONS[0]), F.lit(SEASONS[-1]))
    return (
        spark.read.parquet(f"{sf_dir}/supplier.parquet")
        .select(
            F.col("s_suppkey").cast("string").alias("gsis_id"),
            nation,
            F.date_add(F.lit("1955-01-01").cast("date"), F.floor(balance).cast("int")).alias(
                "birth_date"
            ),
            F.explode(years).alias("season"),
        )
        .filter(~missing)
        .select(
            "gsis_id",
            "season",
            (F.col("season") - F.lit(SEASONS[0]) + nation % 6).cast("int").alias("years_exp"),
            "birth_date",
        )
    )


_stages: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table written at its first use in a Spark application."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _stages:
        _stages[key] = stage(build(), "-".join(str(k) for k in key[1:] if "/" not in str(k)))
    return _stages[key]


def base(spark: SparkSession, sf_dir: str, variant: str = "flags") -> DataFrame:
    """Staged entity-season metrics; the units' offense of the same scan is staged besides."""

    def build() -> DataFrame:
        table, units = P.base_and_offense(
            events(spark, sf_dir, variant, numbered=True), roster(spark, sf_dir, True), roles(variant), stage,
            order_by=["event_number"],
        )
        shared(spark, ("offense", variant, sf_dir), lambda: units)
        return table

    return shared(spark, ("base", variant, sf_dir), build)


def panel(spark: SparkSession, sf_dir: str, variant: str = "flags") -> DataFrame:
    """Staged panel."""

    def build() -> DataFrame:
        table = base(spark, sf_dir, variant)
        units = _stages[spark.sparkContext.applicationId, "offense", variant, sf_dir]
        return P.build_panel(events(spark, sf_dir, variant), table, stage=stage, offense=units)

    return shared(spark, ("panel", variant, sf_dir), build)
