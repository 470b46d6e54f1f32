import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfade.operators import encode, split
from crossfade.plans import features


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0), (7.0, None)], "x double, c double")
    out = encode.standardize(df, ["x", "c"]).collect()
    x = np.array([1.0, 3.0, 3.0, 7.0])
    assert [r.x for r in out] == pytest.approx(list((x - x.mean()) / x.std()))
    assert {r.c for r in out} == {0.0}


def test_fitted_parameters_apply_to_other_rows(spark):
    train = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    params = encode.fit_standardize(train, ["x"])
    other = spark.createDataFrame([(5.0,), (None,)], "x double")
    assert [r.x for r in encode.apply_standardize(other, params).collect()] == [0.0, 0.0]


def test_one_hot_drops_the_first_level_and_keeps_null_as_zero(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "s string")
    out = {r.s: (r.s_b, r.s_c) for r in encode.one_hot(df, "s").collect()}
    assert out == {"a": (0, 0), "b": (1, 0), "c": (0, 1), None: (0, 0)}


def test_one_hot_refuses_many_levels(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("s"))
    assert encode.levels(df, "s") is None
    with pytest.raises(ValueError):
        encode.one_hot(df, "s")


def test_label_encode_by_first_appearance(spark):
    rows = [("z", 3), ("a", 1), ("z", 0), (None, 2), ("m", 5), ("a", 9)]
    df = spark.createDataFrame(rows, "s string, t int").repartition(4)
    got = {r.s: r.s_encoded for r in encode.label_encode(df, "s", ["t"]).collect()}
    assert got == {"z": 0, "a": 1, "m": 2, None: -1}


def test_number_rows_over_many_tasks(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("v")).repartition(7)
    out = encode.number_rows(df, ["v"]).collect()
    assert sorted(r["index"] for r in out) == list(range(1000))
    assert all(r["index"] == r.v - 1 for r in out)


def test_target_encode(spark):
    rows = [("x", 1.0), ("x", 3.0), ("y", 8.0), (None, 4.0), ("w", None)]
    df = spark.createDataFrame(rows, "team string, z_score double")
    out = {r.team: r.team_encoded for r in encode.target_encode(df, "team", smoothing=5.0).collect()}
    overall = 4.0
    assert out["x"] == pytest.approx((4 + 5 * overall) / 7)
    assert out["y"] == pytest.approx((8 + 5 * overall) / 6)
    assert out[None] == overall and out["w"] == overall


def test_target_encode_fitted_on_other_rows(spark):
    train = spark.createDataFrame([("x", 2.0)], "team string, z_score double")
    test = spark.createDataFrame([("x", 99.0), ("new", 99.0)], "team string, z_score double")
    out = {
        r.team: r.team_encoded
        for r in encode.target_encode(test, "team", smoothing=1.0, fit_on=train).collect()
    }
    assert out == {"x": 2.0, "new": 2.0}


def test_target_encode_passes_other_types_through(spark):
    df = spark.createDataFrame([(7, 1.0)], "team int, z_score double")
    assert encode.target_encode(df, "team").first().team_encoded == 7


def test_orthogonal_polynomial(spark):
    rng = random.Random(4)
    ages = [rng.uniform(20, 40) for _ in range(60)]
    df = spark.createDataFrame([(a,) for a in ages], "age double")
    out = np.array([[r.age_poly1, r.age_poly2] for r in encode.orthogonal_poly2(df).collect()])
    assert out.T @ out == pytest.approx(np.eye(2), abs=1e-10)
    assert out.sum(axis=0) == pytest.approx([0, 0], abs=1e-10)
    basis, _ = np.linalg.qr(np.vander(ages, 3, increasing=True))
    assert abs(basis[:, 1:].T @ out) == pytest.approx(np.eye(2), abs=1e-9)


def test_pca_scores(spark):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((str(i), 1, a, a + 0.1 * b, b if i % 9 else None))
    df = spark.createDataFrame(rows, "gsis_id string, season int, x double, y double, w double")
    fitted = encode.fit_pca(df, ["x", "y", "w"], k=10)
    scores = encode.pca_scores(df, ["x", "y", "w"], fitted=fitted).toPandas()
    assert list(scores.columns) == ["gsis_id", "season", "PC1", "PC2", "PC3"]
    s = scores[["PC1", "PC2", "PC3"]].to_numpy()
    covariance = np.cov(s.T)
    assert covariance - np.diag(np.diag(covariance)) == pytest.approx(np.zeros((3, 3)), abs=1e-9)
    shares = [r.Explained_Variance for r in encode.pca_explained_variance(spark, fitted[1]).collect()]
    assert shares == pytest.approx(np.diag(covariance) / np.trace(covariance))
    assert sum(shares) == pytest.approx(1)


def _panel(spark, n=400):
    rng = random.Random(6)
    return spark.createDataFrame(
        [(f"e{i}", s, "RB", rng.gauss(0, 1)) for i in range(n) for s in range(3)],
        "gsis_id string, season int, position_group string, z_score double",
    )


def test_random_split_is_repeatable_and_near_its_weights(spark):
    df = _panel(spark)
    first = split.random_split(df, ["gsis_id", "season"])
    again = split.random_split(df.repartition(5), ["gsis_id", "season"])
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    share = {r.data_split: r["count"] / 1200 for r in first.groupBy("data_split").count().collect()}
    assert share == pytest.approx({"train": 0.7, "validation": 0.15, "test": 0.15}, abs=0.05)


def test_no_entity_on_both_sides(spark):
    df = _panel(spark)
    labelled = split.entity_holdout_split(df)
    both = labelled.groupBy("gsis_id").agg(F.count_distinct("data_split").alias("n"))
    assert both.filter("n > 1").count() == 0
    train, test = split.split_by_entities(df, split.holdout_entities(df))
    assert train.count() + test.count() == df.count()
    assert test.count() == labelled.filter("data_split = 'test'").count()
    assert 0.1 < test.count() / df.count() < 0.3


def test_time_split_covers_all_rows(spark):
    df = spark.createDataFrame([(t,) for t in (-3, -2, 0, 1, None)], "rel_time int")
    labels = [r.data_split for r in split.time_split(df).collect()]
    assert labels == ["train", "validation", "validation", "test", "test"]


def test_position_indicators_are_sorted_and_for_all_groups(spark):
    df = spark.createDataFrame([(p,) for p in "edcba"] + [(None,)], "position_group string")
    assert features.first_positions(df) == ["a", "b", "c", "d", "e"]
    assert features.first_positions(df, 2) == ["a", "b"]


def test_unknown_modes_are_refused(spark):
    with pytest.raises(ValueError):
        features.master_features(spark.range(1), "other")
    with pytest.raises(ValueError):
        features.preprocess(spark.range(1), "other")


def test_preprocess_orders(spark, sf_dir):
    from crossfade.catalog import fixture as fx

    enriched = features.enrich(fx.panel(spark, sf_dir))
    for order in ("raw", "reference"):
        out = features.preprocess(enriched, order).toPandas()
        assert len(out) == enriched.count()
        assert not out["metric_raw"].isna().any() and not out["success_rate"].isna().any()
        assert math.isclose(out["metric_raw"].mean(), 0, abs_tol=1e-9)
        assert math.isclose(out["metric_raw"].std(ddof=0), 1, abs_tol=1e-9)
        assert {"pre_trend_category", "exp_group", "adjustment_phase", "data_split"} <= set(out)


def test_master_with_components(spark, sf_dir):
    from crossfade.catalog import fixture as fx

    panel = fx.panel(spark, sf_dir)
    columns = ["metric_raw", "age", "team_quality"]
    out = features.master_features(panel, pca_columns=columns)
    assert {"PC1", "PC2", "PC3", "z_score_roll2"} <= set(out.columns)
    assert out.count() == panel.count()
    assert features.master_features(panel, "copy") is panel


def test_preprocessing_learned_from_other_rows(spark):
    def rows(values):
        return spark.createDataFrame(
            [(f"e{i}", 2000 + i % 3, g, t, x, 0.5, 1.0, 2, 1, 0) for i, (g, t, x) in enumerate(values)],
            "gsis_id string, season int, position_group string, team string, metric_raw double, z_score double, "
            "team_quality double, years_exp int, years_since_change int, rel_time int",
        ).withColumns({"pre_trend_slope": F.lit(0.1), "age": F.lit(25.0), "sd_season": F.lit(1.0)})

    train = rows([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 10.0), ("b", None, None), ("a", "x", None)])
    fitted, own = features.fit_preprocess(train, one_hot=["position_group"], labels=["team"])
    assert own.count() == 5
    other = rows([("a", "x", None), ("b", "new", None), ("c", "y", 1e9), ("a", "x", None), ("a", None, 2.0)])
    found = fitted.apply(other).orderBy("gsis_id").collect()
    same = {r.gsis_id: r for r in own.collect()}
    assert len(found) == 5
    # the train median of group a, and the whole column's scale
    assert found[0].metric_raw == found[4].metric_raw == same["e4"].metric_raw
    assert [r.team_encoded for r in found] == [0, -1, 1, 0, 0]
    assert [r.position_group_b for r in found] == [0, 1, 0, 0, 0]
    assert found[2].metric_raw < 100  # capped by the train fences
