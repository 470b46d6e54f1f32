"""Metrics, moves and the panel on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from crossfade.catalog import fixture as fx
from crossfade.catalog.queries import QUERIES
from crossfade.functions import exprs as X
from crossfade.operators import filters, joins, metrics, windows
from crossfade.plans import panel as P
from crossfade.sources.staging import stage

COLUMNS = (
    "gsis_id string, season int, position_group string, team string, metric_raw double, "
    "years_exp int, z_score double"
)


def _table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def _by_key(df, *values):
    return {
        (r.gsis_id, r.season, r.position_group): tuple(r[v] for v in values) for r in df.collect()
    }


def test_zscore_of_one_row_and_of_equal_rows_is_missing(spark):
    rows = [
        ("a", 1, "RB", "x", 5.0, 1, None),
        ("a", 2, "RB", "x", 4.0, 1, None),
        ("b", 2, "RB", "x", 4.0, 1, None),
        ("a", 3, "RB", "x", 1.0, 1, None),
        ("b", 3, "RB", "x", 3.0, 1, None),
        ("c", 3, "RB", "x", None, 1, None),
    ]
    z = _by_key(windows.zscore_by_season_group(_table(spark, rows).drop("z_score")), "z_score")
    assert z["a", 1, "RB"] == (None,) and z["a", 2, "RB"] == (None,)
    assert z["a", 3, "RB"][0] == pytest.approx(-(2**-0.5)) and z["c", 3, "RB"] == (None,)


def test_zscores_have_mean_zero_and_deviation_one(spark):
    rng = random.Random(1)
    rows = [
        (str(i), s, "RB", "x", rng.random(), 1, None) for i in range(50) for s in range(3)
    ]
    out = windows.zscore_by_season_group(_table(spark, rows).drop("z_score"))
    for r in out.groupBy("season").agg(F.avg("z_score"), F.stddev_samp("z_score")).collect():
        assert r[1] == pytest.approx(0, abs=1e-12) and r[2] == pytest.approx(1)


def test_moves_with_ties_gaps_and_missing_teams(spark):
    rows = [
        ("a", 1, "QB", "y", 1.0, 5, 0.0),
        ("a", 1, "RB", "x", 1.0, 5, 0.0),
        ("a", 4, "RB", None, 1.0, 5, 0.0),
        ("a", 5, "RB", "y", 1.0, 5, 0.0),
        ("a", 6, "RB", "z", 1.0, 5, 0.0),
    ]
    for order in (rows, rows[::-1]):
        moves = windows.detect_moves(_table(spark, order))
        got = _by_key(moves, "prev_team", "changed_team", "years_since_change")
        assert got["a", 1, "RB"] == (None, 0, 0)
        assert got["a", 1, "QB"] == ("x", 1, 1)
        assert got["a", 4, "RB"] == ("y", 0, 1)
        assert got["a", 5, "RB"] == (None, 0, 1)
        assert got["a", 6, "RB"] == ("y", 1, 2)


def test_single_columns_agree_with_detect_moves(spark):
    rng = random.Random(2)
    rows = [
        (str(e), s, g, rng.choice("xyz"), 1.0, s, 0.0)
        for e in range(20) for s in range(6) for g in ("RB", "QB") if rng.random() < 0.8
    ]
    df = _table(spark, rows)
    steps = windows.cumulative_moves(windows.team_change_flag(windows.prev_team(df)))
    columns = ("prev_team", "changed_team", "years_since_change")
    assert _by_key(steps, *columns) == _by_key(windows.detect_moves(df), *columns)


def test_first_transition_as_window_equals_join(spark):
    rng = random.Random(3)
    rows = [
        (str(e), s, g, rng.choice("xyz"), 1.0, s - 1, rng.gauss(0, 1))
        for e in range(40) for s in range(8) for g in ("RB", "QB") if rng.random() < 0.7
    ]
    moves = windows.detect_moves(_table(spark, rows))
    joined = joins.join_first_transition(moves, windows.first_transition(moves))
    columns = ("transition_season", "new_team", "team")
    assert _by_key(joined, *columns) == _by_key(windows.with_first_transition(moves), *columns)


def test_pre_trend_as_window_equals_join(spark):
    rng = random.Random(4)
    rows = [
        (str(e), s, "RB", "x", 1.0, s, rng.gauss(0, 1))
        for e in range(30) for s in range(-2, 3) if rng.random() < 0.6
    ]
    panel = _table(spark, rows).withColumn("rel_time", F.col("season"))
    joined = _by_key(joins.join_pre_trend(panel, P.pre_trend_slope(panel)), "pre_trend_slope")
    window = _by_key(P.with_pre_trend(panel), "pre_trend_slope")
    assert joined.keys() == window.keys()
    for k, (a,) in joined.items():
        (b,) = window[k]
        assert (a is None) == (b is None) and (a is None or a == pytest.approx(b))
    assert {v for (v,) in joined.values()} >= {None, 0.0}


EVENTS = (
    "game_id string, play_id long, season int, posteam string, yards_gained double, epa double, "
    "success double, passer_player_id string, rusher_player_id string, "
    "receiver_player_id string, pass_attempt double, rush_attempt double, sack double"
)


def _events(spark, n=400, seed=5):
    rng = random.Random(seed)
    maybe = lambda v, p: v if rng.random() < p else None
    rows = []
    for i in range(n):
        rush = rng.random() < 0.4
        # one player takes a third of all events
        player = "hot" if rng.random() < 0.34 else f"p{rng.randrange(6)}"
        rows.append((
            f"g{rng.randrange(9)}", i, rng.randrange(3), maybe(rng.choice("xyz"), 0.9),
            maybe(float(rng.randrange(20)), 0.9), rng.gauss(0, 1), float(rng.random() < 0.5),
            maybe(f"q{rng.randrange(3)}", 0.9), maybe(player, 0.9) if rush else None,
            None if rush else maybe(player, 0.8), float(not rush), float(rush),
            float(rng.random() < 0.1),
        ))
    return spark.createDataFrame(rows, EVENTS)


ROLES = [
    metrics.Role(r.label, r.player_id, r.attempts, r.metric, 5, r.extras) for r in metrics.ROLES
]


@pytest.mark.parametrize("numbered", [False, True])
def test_one_scan_metrics_equal_the_union_of_roles(spark, numbered):
    events = _events(spark)
    if numbered:
        number = F.substring("game_id", 2, 1).cast("long") * 10_000 + F.col("play_id")
        one = metrics.role_metrics(events.withColumn("n", number), ROLES, order_by=["n"])
    else:
        one = metrics.role_metrics(events, ROLES)
    for df in (one, metrics.rush_efficiency(events), metrics.last_team(events, ["season"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # the events are hashed; what is sorted are the sums per unit
        assert plan.split("SortAggregate")[-1].count("HashAggregate") == 2
    union = metrics.union_positions(*[metrics.efficiency(events, r) for r in ROLES])
    assert set(one.columns) == set(union.columns)
    columns = sorted(one.columns)
    key = lambda r: tuple(
        round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns
    )
    assert {key(r) for r in one.collect()} == {key(r) for r in union.collect()}
    assert one.count() == union.count() > 10


def test_two_means_differ_in_their_denominator(spark):
    rows = [
        ("g", i, 1, "x", y, 0.0, 1.0, None, "r", "c", 1.0, 1.0, 0.0)
        for i, y in enumerate((4.0, None))
    ]
    events = spark.createDataFrame(rows, EVENTS)
    rush, target = (
        metrics.efficiency(events, metrics.Role(r.label, r.player_id, r.attempts, r.metric, 1))
        for r in (metrics.RUSH, metrics.TARGET)
    )
    assert rush.first().metric_raw == 4.0 and target.first().metric_raw == 2.0


def test_last_team_keeps_a_missing_team(spark):
    rows = [("g1", 1, "x"), ("g2", 1, None)]
    events = spark.createDataFrame(rows, "game_id string, play_id long, posteam string")
    out = metrics.last_team(events.withColumn("k", F.lit(1)), ["k"])
    assert out.first().team is None


def test_volume_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(99,), (100,), (101,)], "volume int")
    assert filters.having_min_volume(df, 100).count() == 2


def test_missing_team_finds_its_average(spark):
    rows = [("a", 1, "RB", None, 1.0, 1, 2.0), ("b", 1, "RB", None, 1.0, 1, 4.0)]
    base = _table(spark, rows)
    out = joins.join_team_pos_avg(base, metrics.team_position_avg(base))
    assert [r.team_pos_avg for r in out.collect()] == [3.0, 3.0]


def test_roster_duplicates_fan_out(spark):
    base = _table(spark, [("a", 1, "RB", "x", 1.0, None, 0.0)]).drop("years_exp")
    roster = spark.createDataFrame(
        [("a", 1, 3, 20.0), ("a", 1, 4, 20.0)], "gsis_id string, season int, years_exp int, age double"
    )
    assert joins.join_roster_left(base, roster).count() == 2


def test_required_columns_are_checked(spark):
    with pytest.raises(ValueError, match="missing columns: epa"):
        filters.filter_regular(spark.range(1).withColumn("season_type", F.lit("REG")), columns=[])


def test_moves_and_trend_share_one_exchange_and_one_sort(spark):
    rows = [("a", s, "RB", "x", 1.0, 1, 0.0) for s in range(3)]
    base = _table(spark, rows)
    plan = P.with_pre_trend(P.relative_panel(base))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(gsis_id") == 1
    assert plan.count("+- Sort [") == 1


def test_phase_and_relative_time(spark):
    df = spark.createDataFrame([(1999, 2001), (2001, 2001), (None, 2001)], "s int, t int")
    rel = X.relative_time("s", "t")
    rows = df.select(rel.alias("r"), X.post_flag(rel).alias("p"), X.phase_label(rel).alias("l"))
    assert [tuple(r) for r in rows.collect()] == [(-2, 0, "Pre"), (0, 1, "Post"), (None, None, None)]


def test_event_numbers_order_as_games_do_and_need_no_game_in_the_shuffle(spark, sf_dir):
    rows = filters.filter_regular(
        fx.events(spark, sf_dir, numbered=True), columns=[*filters.EVENT_COLUMNS, "event_number"]
    )
    named = metrics.role_metrics(rows, fx.roles("flags"))
    by_number = metrics.role_metrics(rows, fx.roles("flags"), order_by=["event_number"])
    plan = by_number._jdf.queryExecution().executedPlan().toString()
    assert "posteam" in plan and "game_id" not in plan
    key = lambda r: (r.gsis_id, r.season, r.position_group, r.volume, r.team)
    assert {key(r) for r in named.collect()} == {key(r) for r in by_number.collect()}


def test_team_averages_are_not_sorted_for_their_join(spark, sf_dir):
    plan = QUERIES["join_team_pos_avg"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_units_and_roles_from_one_scan(spark):
    events = _events(spark).withColumn("season_type", F.lit("REG"))
    sums = metrics.role_and_unit_sums(events, ROLES)
    near = lambda df: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()}
    roles, units = metrics.role_metrics(events, ROLES), metrics.team_offense_context(events)
    assert near(metrics.role_table(sums, ROLES).select(*roles.columns)) == near(roles)
    assert near(metrics.unit_table(sums).select(*units.columns)) == near(units) and units.count() == 12


def test_panel_reads_the_events_once(spark, sf_dir):
    read = []

    def staged(df, name="table"):
        read.extend(f for f in df.inputFiles() if "lineitem" in f)
        return stage(df, name)

    base, offense = P.base_and_offense(
        fx.events(spark, sf_dir, numbered=True), fx.roster(spark, sf_dir, True), fx.roles("flags"), staged, ["event_number"]
    )
    staged(P.build_panel(fx.events(spark, sf_dir), staged(base), stage=staged, offense=offense))
    assert len(read) == 1


def test_events_are_summed_before_they_are_expanded(spark):
    rows = [  # the receiver's units come from two passers; the last event has the second's
        ("g1", 1, 1, "x", 4.0, 1.0, 1.0, "p1", None, "c", 1.0, 0.0, 0.0),
        ("g1", 2, 1, "x", None, 3.0, 0.0, "p1", None, "c", 1.0, 0.0, 1.0),
        ("g1", 3, 1, "y", 8.0, 2.0, 1.0, "p2", None, "c", 1.0, 0.0, 0.0),
        ("g1", 4, 1, "y", 1.0, 6.0, 0.0, None, None, "c", 0.0, 0.0, 0.0),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    sums = metrics.role_and_unit_sums(events, ROLES, order_by=["play_id"])
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortAggregate" not in plan
    assert sums.count() == 2  # a row per passer, receiver and unit; none for what counts for nobody
    few = [metrics.Role(r.label, r.player_id, r.attempts, r.metric, 1, r.extras) for r in ROLES]
    table = {r.gsis_id: r for r in metrics.role_table(sums, few, order_by=["play_id"]).collect()}
    assert table["c"].volume == 3 and table["c"].team == "y" and table["c"].metric_raw == 4.0
    assert table["p1"].volume == 2 and table["p1"].team == "x" and table["p1"].metric_raw == 2.0
    units = {r.posteam: r for r in metrics.unit_table(sums).collect()}
    assert units["x"].team_sack_rate == 0.5 and units["y"].team_pass_epa_per_play == 2.0
    assert units["x"].team_rush_epa_per_play is None
