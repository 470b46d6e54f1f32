import pytest
from pyspark.sql import functions as F

from crossfade.operators import windows
from crossfade.plans import features

COLUMNS = "gsis_id string, season int, position_group string, z_score double"


def _by_season(df, *columns):
    return {(r.gsis_id, r.season): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [
        ("a", 1, "RB", 1.0), ("a", 2, "RB", None), ("a", 4, "RB", 4.0), ("a", 5, "RB", 8.0),
        ("b", 1, "RB", None), ("b", 2, "RB", 3.0),
        ("c", 1, "RB", 2.0),
        (None, 1, "RB", 1.0), (None, 2, "RB", 5.0),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_rolling_ignores_missing_values(panel):
    df = windows.rolling_mean(windows.rolling_volatility(panel, 2), 3)
    got = _by_season(df, "z_score_roll3", "z_score_vol2")
    assert got["a", 2] == (1.0, None)
    assert got["a", 4] == (2.5, None)
    assert got["a", 5][0] == 6.0 and got["a", 5][1] == pytest.approx(8**0.5)
    assert got["c", 1] == (2.0, None)
    assert got[None, 2] == (None, None)


def test_momentum_and_acceleration(panel):
    got = _by_season(
        windows.acceleration(windows.momentum(panel)), "z_score_momentum", "z_score_acceleration"
    )
    assert got["a", 1] == (None, None) and got["a", 4] == (None, None)
    assert got["a", 5] == (4.0, None)
    assert got[None, 2] == (None, None)


def test_acceleration_needs_momentum(panel):
    with pytest.raises(ValueError):
        windows.acceleration(panel)


def test_cumulative_change_from_a_missing_first_value(panel):
    got = _by_season(windows.cumulative_change(panel), "z_score_cumulative_change")
    assert got["a", 5] == (7.0,) and got["b", 2] == (None,) and got["c", 1] == (0.0,)


def test_entity_volatility(panel):
    got = _by_season(windows.entity_volatility(panel), "performance_variance")
    assert got["a", 1][0] == pytest.approx(3.5118845842842465)
    assert got["c", 1] == (None,) and got[None, 1] == (None,)


def test_row_order_does_not_matter(spark, panel):
    rows = panel.collect()
    reverse = spark.createDataFrame(rows[::-1], COLUMNS)
    for build in (features.rolling_features, features.momentum_features):
        a, b = build(panel), build(reverse)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_feature_windows_share_one_exchange(panel):
    plan = features.momentum_features(features.rolling_features(panel))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_features_equal_single_operators(panel):
    whole = features.momentum_features(features.rolling_features(panel))
    single = windows.acceleration(windows.momentum(windows.rolling_mean(panel, 2)))
    columns = ("z_score_roll2", "z_score_momentum", "z_score_acceleration")
    assert _by_season(whole, *columns) == _by_season(single, *columns)


def test_rows_without_an_entity_are_dealt_out(spark):
    rows = [(None if i % 3 == 0 else f"e{i % 50}", 2000 + i % 7, "RB", float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "gsis_id string, season int, position_group string, z_score double")
    added = {
        "z_score_roll2": lambda d: windows.rolling_mean(d, 2), "z_score_vol2": lambda d: windows.rolling_volatility(d, 2), "z_score_momentum": windows.momentum,
        "z_score_cumulative_change": windows.cumulative_change, "performance_variance": windows.entity_volatility,
    }
    for name, add in added.items():
        found = add(df)
        assert found.count() == 3000 and found.filter("gsis_id IS NULL").select(F.count(name)).first()[0] == 0
        assert found.filter("gsis_id IS NOT NULL").select(F.count(name)).first()[0] > 1900
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            parts = add(df).groupBy(F.spark_partition_id().alias("p"), F.isnull("gsis_id").alias("apart")).agg(F.count("*").alias("n"), F.max(name))
            sizes = [r["n"] for r in parts.collect() if r["apart"]]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert sum(sizes) == 1000 and max(sizes) < 500
