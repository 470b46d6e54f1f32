from datetime import date

import pytest
from pyspark.sql import functions as F

from crossfade.functions import exprs as X


@pytest.fixture(scope="module")
def edges(spark):
    values = [-1.0, -0.05, 0.0, 0.05, 1.0, 3.0, 7.0, 12.0, 12.5, None]
    return spark.createDataFrame([(v,) for v in values], "x double")


def _map(df, column):
    return {r[0]: r[1] for r in df.select("x", column.alias("y")).collect()}


def test_bins_are_right_closed(edges):
    level = _map(edges, X.performance_level("x"))
    assert level[-1.0] == "Below Avg" and level[0.0] == "Average"
    assert level[1.0] == "Above Avg" and level[3.0] == "Elite" and level[None] is None


def test_experience_bins_start_above_zero(edges):
    phase = _map(edges, X.career_phase("x"))
    assert phase[0.0] is None and phase[-1.0] is None and phase[None] is None
    assert [phase[v] for v in (3.0, 7.0, 12.0, 12.5)] == [
        "Early", "Prime", "Veteran", "Late Career",
    ]
    group = _map(edges, X.exp_group("x"))
    assert [group[v] for v in (3.0, 7.0, 12.0, 12.5)] == [
        "Rookie", "Early Career", "Prime", "Veteran",
    ]


def test_trend_bins(edges):
    trend = _map(edges, X.pre_trend_category("x"))
    assert (trend[-0.05], trend[0.05], trend[1.0]) == ("Declining", "Stable", "Improving")


def test_missing_moves_are_established(edges):
    phase = _map(edges, X.adjustment_phase("x"))
    assert phase[1.0] == "Transition" and phase[3.0] == "Adjustment"
    assert phase[7.0] == "Established" and phase[None] == "Established"


def test_split_label_of_a_missing_time_is_test(edges):
    label = _map(edges, X.split_label("x"))
    assert label[None] == "test" and label[0.0] == "validation" and label[3.0] == "test"


def test_clip_keeps_null(edges):
    clipped = _map(edges, X.clip("x", 0.0, 5.0))
    assert clipped[None] is None and clipped[-1.0] == 0.0 and clipped[12.0] == 5.0


def test_age(spark):
    df = spark.createDataFrame([(2020, date(1990, 9, 1))], "season int, birth date")
    age = df.select(X.age_on_season_start("season", "birth")).first()[0]
    assert age == pytest.approx(10958 / 365.25, abs=1e-12)


def test_team_quality(spark):
    df = spark.createDataFrame(
        [("RB", 0.1, 0.2), ("QB", 0.1, 0.2), ("K", 0.1, 0.2), ("QB", 0.1, None)],
        "g string, p double, s double",
    )
    quality = X.team_quality(F.col("g"), F.col("p"), F.col("s"))
    assert [r[0] for r in df.select(quality).collect()] == [0.1, -0.2, 0.0, 0.0]


def test_contract_years(spark):
    rows = [("RB", 6), ("RB", 9), ("QB", 9), ("QB", 6), ("WR_TE", 7), ("RB", None), (None, 7)]
    df = spark.createDataFrame(rows, "g string, e int")
    flags = [r[0] for r in df.select(X.contract_year_flag("g", "e")).collect()]
    assert flags == [1, 0, 1, 0, 0, 0, 0]


def test_scaled_metric_and_powers(spark):
    df = spark.createDataFrame([(2.0, 0.0)], "m double, s double")
    row = df.select(
        X.scaled_metric("m", "s").alias("a"), X.power("m", 3).alias("b"),
        X.exp_decay("m").alias("c"), X.peak_distance("m").alias("d"),
    ).first()
    assert row.a == pytest.approx(2e10) and row.b == 8.0 and row.d == -3.0
    assert row.c == pytest.approx(0.8187307530779818)
