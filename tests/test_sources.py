import pytest
from pyspark.sql import functions as F

from crossfade.sources import scan, sinks, staging


def test_csv_reads_the_missing_mark_and_types(spark, tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text("gsis_id,season,z_score\na,2001,NA\nb,2002,1.5\n")
    schema = "gsis_id string, season int, z_score double"
    rows = scan.scan_panel_csv(spark, str(path), schema).orderBy("season").collect()
    assert [tuple(r) for r in rows] == [("a", 2001, None), ("b", 2002, 1.5)]


def test_csv_round_trip_keeps_nulls_and_digits(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2, None), (2, None, "x")], "k int, x double, s string")
    sinks.sink_csv(df, str(tmp_path / "out"))
    back = scan.scan_panel_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert [r.x for r in scan.nan_to_null(df).collect()] == [None, 2.0]


def test_event_scan_pushes_seasons_down(spark, tmp_path):
    rows = spark.range(20).select(
        *[
            F.lit(None).cast(f.dataType).alias(f.name)
            if f.name != "season"
            else (F.col("id") % 4 + 2015).cast("int").alias("season")
            for f in scan.EVENT_SCHEMA.fields
        ]
    )
    sinks.sink_parquet(rows, str(tmp_path / "events"))
    df = scan.scan_events(spark, str(tmp_path / "events"), [2015, 2017])
    assert df.count() == 10
    plan = df.select("epa")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(season, [2015,2017])]" in plan
    assert "ReadSchema: struct<season:int,epa:double>" in plan


def test_season_folders_are_pruned(spark, tmp_path):
    df = spark.range(8).select((F.col("id") % 4).cast("int").alias("season"), "id")
    sinks.sink_parquet(df, str(tmp_path / "t"), ["season"])
    plan = scan.scan_parquet(spark, str(tmp_path / "t"), seasons=[1])
    assert plan.count() == 2
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in text or "PartitionFilters: [season" in text


def test_split_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "test")], "k int, data_split string")
    sinks.sink_by_split(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "data_split=test")).count() == 2


def test_stage_uses_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert staging.shared_folder(spark) == folder
    staged = staging.stage(spark.range(5).toDF("n"), "numbers")
    assert staged.count() == 5 and all(folder in f for f in staged.inputFiles())
    assert staging.stage_path(spark, "a") != staging.stage_path(spark, "a")


def test_roster_scan(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2, None)], scan.ROSTER_SCHEMA)
    sinks.sink_parquet(df, str(tmp_path / "r"))
    assert scan.scan_roster(spark, str(tmp_path / "r"), [1]).count() == 1
    with pytest.raises(Exception):
        scan.scan_roster(spark, str(tmp_path / "absent")).count()
