from statistics import NormalDist

import numpy as np
import pytest

from crossfade.operators import charts


def test_boxplot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("RB", "Pre", v) for v in values], "position_group string, phase string, team_quality double")
    row = charts.boxplot_stats(df).first()
    assert (row.q1, row.median, row.q3) == (2.0, 3.0, 4.0)
    assert (row.whisker_low, row.whisker_high, row.n_outliers) == (1.0, 4.0, 1)


def test_histogram_counts_every_row_once(spark):
    df = spark.createDataFrame([(float(i),) for i in range(31)] + [(None,)], "error double")
    rows = charts.error_histogram(df).collect()
    assert sum(r.n for r in rows) == 31
    assert max(r.bin for r in rows) == 30 and min(r.bin for r in rows) == 1
    assert {r.bin: r.n for r in rows}[30] == 2


def test_histogram_of_one_value_and_of_nothing(spark):
    one = spark.createDataFrame([(2.0,), (2.0,)], "error double")
    assert [(r.bin, r.n) for r in charts.error_histogram(one).collect()] == [(1, 2)]
    assert charts.error_histogram(one.filter("error > 5")).count() == 0


def test_qq_points(spark):
    values = [NormalDist(3, 2).inv_cdf((i + 0.5) / 2000) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "residual double")
    for exact in (True, False):
        rows = charts.qq_points(df, exact=exact).collect()
        assert len(rows) == 99
        for r in rows:
            assert r.sample == pytest.approx(3 + 2 * r.theoretical, abs=0.02)
            assert r.line == pytest.approx(3 + 2 * r.theoretical, abs=0.02)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (9.0, None)], "actual double, predicted double")
    row = charts.regression_metrics(df).first()
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    assert row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row.rmse == pytest.approx(((y - p) ** 2).mean() ** 0.5) and row.mae == pytest.approx(0.5)


def test_change_and_line(spark):
    rows = [(f"e{i}", "RB", float(i), t, float(i * t)) for i in range(4) for t in (-1, 1)]
    panel = spark.createDataFrame(rows, "gsis_id string, position_group string, pre_trend_slope double, rel_time int, z_score double")
    change = charts.pre_post_change(panel)
    assert {r.gsis_id: r.post_change for r in change.collect()}["e3"] == 6.0
    line = charts.trend_lines(change).first()
    assert (line.slope, line.intercept, line.r2) == pytest.approx((2.0, 0.0, 1.0))


def test_residual_bins(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(100)], "predicted double, error double")
    rows = charts.residual_vs_fitted(df, bins=10).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.bin)] == [10] * 9 + [10]
    assert {r.mean_residual for r in rows} == {1.0}
