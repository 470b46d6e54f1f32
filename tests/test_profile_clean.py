import random
import statistics

import pytest

from crossfade.operators import clean, profile

ROWS = [
    (1, "a", 1.0), (1, "a", 1.0), (1, "a", 1.0), (2, None, None), (2, None, None), (3, "b", 5.0),
    (None, "b", 7.0),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k int, s string, x double")


def test_duplicates_and_gaps(df):
    assert profile.duplicate_count(df).first()[0] == 3
    assert profile.rows_with_nulls(df).first()[0] == 3
    row = profile.completeness(df).first()
    assert row.complete_rows == 4 and row.completeness_pct == pytest.approx(100 * 16 / 21)
    assert clean.drop_duplicates(df).count() == 4


def test_quality_report_agrees_with_single_figures(df):
    row = profile.quality_report(df).first()
    assert (row.total_rows, row.total_columns, row.duplicate_rows) == (7, 3, 3)
    assert (row.missing_k, row.missing_s, row.missing_x) == (1, 2, 2)


def test_missing_profile_lists_only_columns_with_gaps(spark, df):
    out = [tuple(r) for r in profile.missing_profile(df).collect()]
    assert out == [("s", 2, 28.57), ("x", 2, 28.57), ("k", 1, 14.29)]
    assert profile.missing_profile(spark.range(3)).count() == 0


def test_reports_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k int, x double")
    assert profile.duplicate_count(empty).first()[0] == 0
    assert profile.quality_report(empty).first().total_rows == 0
    assert profile.describe_numeric(empty).count() == 2
    assert profile.completeness(empty).first().completeness_pct is None


def test_summaries_leave_out_missing_keys(spark):
    df = spark.createDataFrame(
        [("e", 1, 2.0), ("e", 1, 4.0), (None, 1, 9.0), ("e", None, 9.0)],
        "gsis_id string, season int, x double",
    )
    row = profile.entity_season_summary(df).collect()
    assert len(row) == 1
    assert (row[0].x_mean, row[0].x_sum, row[0].x_count, row[0].season_mean) == (3.0, 6.0, 2, 1.0)
    assert row[0].x_std == pytest.approx(2**0.5)


def test_value_counts_order(df):
    assert [tuple(r) for r in profile.value_counts(df, "s").collect()] == [("a", 3), ("b", 2)]


def test_distinct_counts_exact_and_sketch(df):
    for exact in (True, False):
        got = {r.column_name: r.n_distinct for r in profile.distinct_counts(df, exact=exact).collect()}
        assert got == {"k": 3, "s": 2, "x": 3}


def test_sums_in_another_order_are_one_value(spark):
    a, b = (0.1 + 0.2) + 0.3, 0.1 + (0.2 + 0.3)
    assert a != b
    df = spark.createDataFrame([("p", a), ("q", b), ("r", 0.6000001), ("s", -0.0), ("t", 0.0), ("u", None)], "k string, x double")
    for report in (profile.distinct_counts, profile.feature_metadata):
        assert {r.column_name: r.n_distinct for r in report(df, places=10).collect()} == {"k": 6, "x": 3}


def test_describe_by_sketch_and_by_selection(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.random(),) for _ in range(500)], "x double")
    exact = profile.describe_numeric(df).first()
    assert exact.q25 == pytest.approx(statistics.quantiles([r.x for r in df.collect()], n=4, method="inclusive")[0])
    sketch = profile.describe_numeric(df, exact=False).first()
    assert sketch.q25 == pytest.approx(exact.q25, abs=0.01)


def test_impute_group_median(spark):
    rows = [("RB", 1.0, 1), ("RB", 3.0, None), ("RB", None, 4), ("QB", None, 2), (None, None, 1), (None, 8.0, 1)]
    df = spark.createDataFrame(rows, "position_group string, x double, n int")
    out = sorted(map(tuple, clean.impute_group_median(df).collect()), key=str)
    assert ("RB", 2.0, 4.0) in out and ("RB", 3.0, 2.5) in out
    assert ("QB", None, 2.0) in out  # a group without any value
    assert (None, 8.0, 1.0) in out and out.count((None, 8.0, 1.0)) == 2


def test_impute_falls_back_to_team_and_to_the_whole_column(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 9.0)], "team string, x double")
    assert sorted(r.x for r in clean.impute_group_median(df).collect()) == [1.0, 1.0, 9.0]
    bare = df.drop("team")
    assert sorted(r.x for r in clean.impute_group_median(bare).collect()) == [1.0, 5.0, 9.0]


def test_mode_ties_and_empty_columns(spark):
    df = spark.createDataFrame(
        [("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "s string, e string"
    )
    modes = [tuple(r) for r in clean.column_mode(df).collect()]
    assert modes == [("s", "a", 2)]
    filled = clean.impute_mode(df).collect()
    assert filled[-1].s == "a" and {r.e for r in filled} == {"Unknown"}


def test_fences_and_clipping(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 10)] + [(1000.0,), (None,)], "x double")
    bounds = clean.fence_bounds(clean.quartile_fences(df))
    assert bounds["x"] == pytest.approx((3.25 - 3 * 4.5, 7.75 + 3 * 4.5))
    out = [r.x for r in clean.clip_outliers(df, bounds).collect()]
    assert len(out) == 11 and max(v for v in out if v is not None) == 21.25 and out.count(None) == 1
    counts = clean.capped_outlier_counts(df, bounds).collect()
    assert [tuple(r) for r in counts] == [("x", 1)]


def test_fences_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert set(clean.fence_bounds(clean.quartile_fences(df))) == {"y"}


def test_constant_column_collapses(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(5.0,)], "x double")
    bounds = clean.fence_bounds(clean.quartile_fences(df))
    assert {r.x for r in clean.clip_outliers(df, bounds).collect()} == {1.0}


def test_noise_of_large_sums_is_no_value(spark):
    df = spark.createDataFrame([(848.0041020500001,), (848.0041020499999,), (848.00410206,), (1.000000001,), (1.0,)], "x double")
    for places, n in ((None, 5), (9, 4)):
        assert profile.distinct_counts(df, places=places).first().n_distinct == n
        assert profile.feature_metadata(df, places=places).first().n_distinct == n
