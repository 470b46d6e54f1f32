"""One query per operator of the inventory, over the driver's tables.

Doubles are rounded to six places so that the order of floating-point sums
does not show.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfade.catalog import fixture as fx
from crossfade.functions import exprs as X
from crossfade.models import mixed
from crossfade.models import regressors as R
from crossfade.operators import charts, clean, encode, filters, joins, metrics, profile, smooth, split, windows
from crossfade.plans import effects, features
from crossfade.plans import panel as P
from crossfade.sources import scan, sinks
from crossfade.sources.staging import stage, stage_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PLACES = 6
# Distinct values: above the noise of sums in another order (1e-12), below what differs.
DISTINCT_PLACES = 9
KEYS = ("gsis_id", "season", "position_group")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.round(f.name, PLACES) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str):
    """Register a query under ``name``."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        QUERIES[name] = run
        return fn

    return register


def panel(spark, d):
    return fx.panel(spark, d, "flags")


def single(spark, d):
    return fx.panel(spark, d, "single")


def base(spark, d):
    return fx.base(spark, d, "flags")


def regular(spark, d, variant="flags"):
    return filters.filter_regular(fx.events(spark, d, variant))


def moves(spark, d, variant="flags"):
    return windows.detect_moves(fx.base(spark, d, variant))


def scored(spark, d):
    """Panel rows with the team average as a stand-in prediction."""
    df = panel(spark, d).withColumn("prediction", F.col("team_pos_avg"))
    return charts.residual_columns(df, keys=KEYS)


# -- sources and sinks -----------------------------------------------------


@query("scan_events")
def _(spark, d):
    path = stage_path(spark, "events")
    sinks.sink_parquet(fx.events(spark, d), path, ["season"])
    return scan.scan_events(spark, path, seasons=[1995, 1996, 1997, 1999, 2000, 2001])


@query("scan_roster")
def _(spark, d):
    path = stage_path(spark, "roster")
    sinks.sink_parquet(fx.roster(spark, d), path)
    return scan.scan_roster(spark, path)


@query("scan_panel_csv")
def _(spark, d):
    path = stage_path(spark, "panel-csv")
    sinks.sink_csv(panel(spark, d), path)
    return scan.scan_panel_csv(spark, path)


@query("scan_panel_parquet")
def _(spark, d):
    path = stage_path(spark, "panel-parquet")
    sinks.sink_parquet(panel(spark, d), path)
    return scan.scan_panel_parquet(spark, path)


@query("roundtrip_intermediate")
def _(spark, d):
    return sinks.roundtrip(base(spark, d), stage_path(spark, "roundtrip"))


@query("sink_csv")
def _(spark, d):
    path = stage_path(spark, "enriched-csv")
    enriched = features.enrich(panel(spark, d))
    sinks.sink_csv(enriched, path)
    return scan.scan_panel_csv(spark, path, enriched.schema)


@query("sink_parquet")
def _(spark, d):
    path = stage_path(spark, "by-season")
    sinks.sink_parquet(panel(spark, d), path, ["season"])
    return spark.read.parquet(path)


@query("sink_by_split")
def _(spark, d):
    path = stage_path(spark, "by-split")
    sinks.sink_by_split(split.time_split(panel(spark, d)), path)
    return spark.read.parquet(path)


@query("quality_report")
def _(spark, d):
    return profile.quality_report(panel(spark, d))


# -- filters and projections -----------------------------------------------


@query("filter_regular")
def _(spark, d):
    return regular(spark, d)


def _role(spark, d, role):
    rows = filters.filter_role(regular(spark, d), role.attempts, role.player_id)
    return rows.select("game_id", "play_id", "season", role.player_id, "yards_gained", "epa")


@query("filter_role_rush")
def _(spark, d):
    return _role(spark, d, metrics.RUSH)


@query("filter_role_target")
def _(spark, d):
    return _role(spark, d, metrics.TARGET)


@query("filter_role_pass_or_rush")
def _(spark, d):
    return _role(spark, d, metrics.PASS)


def _volumes(spark, d):
    rows = _role(spark, d, metrics.RUSH)
    counts = rows.groupBy("rusher_player_id", "season").agg(F.count(F.lit(1)).alias("volume"))
    return filters.having_min_volume(counts, 16)


@query("having_min_volume")
def _(spark, d):
    return _volumes(spark, d)


@query("project_literal_rename")
def _(spark, d):
    return filters.project_role(_volumes(spark, d), "RB", "rusher_player_id")


@query("filter_window_band")
def _(spark, d):
    timed = windows.with_first_transition(moves(spark, d))
    timed = timed.withColumn("rel_time", X.relative_time("season", "transition_season"))
    return filters.filter_window_band(timed).select(*KEYS, "transition_season", "rel_time")


@query("filter_veteran_moves")
def _(spark, d):
    return filters.filter_veteran_moves(moves(spark, d))


@query("filter_split_isin")
def _(spark, d):
    rows = split.time_split(panel(spark, d))
    return filters.filter_isin(rows, "data_split", ["validation", "test"]).select(
        *KEYS, "rel_time", "data_split"
    )


@query("select_numeric_features")
def _(spark, d):
    return filters.select_numeric_features(panel(spark, d))


@query("transition_events")
def _(spark, d):
    return filters.transition_events(panel(spark, d))


@query("schema_profile")
def _(spark, d):
    return filters.schema_profile(panel(spark, d))


@query("type_counts")
def _(spark, d):
    return filters.type_counts(panel(spark, d))


@query("sample_head")
def _(spark, d):
    order = ["gsis_id", "season", X.ordinal("position_group")]
    return filters.sample_head(panel(spark, d), order)


# -- joins -----------------------------------------------------------------


@query("join_roster_left")
def _(spark, d):
    rows = base(spark, d).drop("years_exp", "age")
    return joins.join_roster_left(rows, P.roster_with_age(fx.roster(spark, d, gaps=True)))


@query("join_first_transition")
def _(spark, d):
    rows = moves(spark, d, "single")
    out = joins.join_first_transition(rows, windows.first_transition(rows))
    return out.select(*KEYS, "team", "transition_season", "new_team")


@query("join_team_pos_avg")
def _(spark, d):
    rows = base(spark, d)
    out = joins.join_team_pos_avg(rows, stage(metrics.team_position_avg(rows), "averages"))
    return out.select(*KEYS, "team", "team_pos_avg")


@query("join_team_offense")
def _(spark, d):
    offense = metrics.team_offense_context(regular(spark, d))
    out = joins.join_team_offense(base(spark, d), offense)
    return out.select(
        *KEYS, "team", "team_pass_epa_per_play", "team_rush_epa_per_play", "team_sack_rate"
    )


@query("join_pre_trend")
def _(spark, d):
    rows = panel(spark, d).drop("pre_trend_slope")
    out = joins.join_pre_trend(rows, P.pre_trend_slope(rows))
    return out.select(*KEYS, "rel_time", "pre_trend_slope")


@query("join_distinct_effects")
def _(spark, d):
    model = _fitted(spark, d, "interaction")
    return joins.join_distinct_effects(single(spark, d), mixed.random_effects(model))


@query("join_back_aggregate")
def _(spark, d):
    rows = panel(spark, d)
    before = rows.filter(F.col("rel_time") < -1).groupBy("team", "season")
    stats = before.agg(F.avg("z_score").alias("m")).groupBy("team").agg(F.avg("m").alias("team_mean"))
    stats = stats.filter(F.col("team_mean") > 0)
    return joins.join_back_aggregate(rows, stats, "team", "team_mean", 0.0).select(
        *KEYS, "team", "team_mean"
    )


def _late_movers(spark, d):
    first = windows.first_transition(moves(spark, d, "single"))
    return first.filter(F.col("transition_season") >= 1998).select("gsis_id")


@query("semi_holdout_entities")
def _(spark, d):
    rows = fx.base(spark, d, "single")
    return joins.semi_holdout(rows, _late_movers(spark, d)).select(*KEYS, "z_score")


@query("anti_holdout_entities")
def _(spark, d):
    rows = fx.base(spark, d, "single")
    return joins.anti_holdout(rows, _late_movers(spark, d)).select(*KEYS, "z_score")


# -- aggregates ------------------------------------------------------------


@query("rush_efficiency")
def _(spark, d):
    return metrics.rush_efficiency(regular(spark, d), fx.roles("flags")[0])


@query("target_efficiency")
def _(spark, d):
    return metrics.target_efficiency(regular(spark, d), fx.roles("flags")[1])


@query("passer_efficiency")
def _(spark, d):
    return metrics.passer_efficiency(regular(spark, d), fx.roles("flags")[2])


@query("role_metrics")
def _(spark, d):
    return metrics.role_metrics(regular(spark, d), fx.roles("flags"))


@query("last_team")
def _(spark, d):
    player = F.coalesce("rusher_player_id", "receiver_player_id", "passer_player_id")
    rows = regular(spark, d).withColumn("gsis_id", player)
    return metrics.last_team(rows, ["gsis_id", "season"])


@query("team_position_avg")
def _(spark, d):
    return metrics.team_position_avg(base(spark, d))


@query("team_offense_context")
def _(spark, d):
    return metrics.team_offense_context(regular(spark, d))


@query("pre_trend_slope")
def _(spark, d):
    return P.pre_trend_slope(single(spark, d))


@query("entity_season_summary")
def _(spark, d):
    return profile.entity_season_summary(panel(spark, d))


@query("team_season_summary")
def _(spark, d):
    return profile.team_season_summary(panel(spark, d))


@query("value_counts")
def _(spark, d):
    return profile.value_counts_of(panel(spark, d), fx.CATEGORIES)


@query("distinct_counts")
def _(spark, d):
    return profile.distinct_counts(panel(spark, d), places=DISTINCT_PLACES)


@query("describe_numeric")
def _(spark, d):
    return profile.describe_numeric(panel(spark, d))


@query("missing_profile")
def _(spark, d):
    return profile.missing_profile(panel(spark, d))


def _repeating(spark, d):
    """All panel rows, and those of the move a second time."""
    rows = rounded(panel(spark, d))
    return rows.unionByName(rows.filter(F.col("rel_time") == 0))


@query("duplicate_count")
def _(spark, d):
    return profile.duplicate_count(_repeating(spark, d))


@query("rows_with_nulls")
def _(spark, d):
    return profile.rows_with_nulls(panel(spark, d))


@query("completeness")
def _(spark, d):
    return profile.completeness(panel(spark, d))


@query("season_range")
def _(spark, d):
    return profile.season_range(panel(spark, d))


@query("quartile_fences")
def _(spark, d):
    return clean.quartile_fences(panel(spark, d))


#: Every number of the panel but the season, which is a key.
MEASURES = fx.MEASURES


@query("group_median")
def _(spark, d):
    return clean.group_median(panel(spark, d), MEASURES)


@query("global_median")
def _(spark, d):
    return clean.global_median(panel(spark, d), MEASURES)


@query("column_mode")
def _(spark, d):
    return clean.column_mode(panel(spark, d))


@query("pre_post_change")
def _(spark, d):
    return charts.pre_post_change(single(spark, d))


@query("capped_outlier_counts")
def _(spark, d):
    rows = panel(spark, d)
    return clean.capped_outlier_counts(rows, clean.fence_bounds(clean.quartile_fences(rows)))


@query("error_summary")
def _(spark, d):
    return charts.error_summary(scored(spark, d))


@query("regression_metrics")
def _(spark, d):
    return charts.regression_metrics(scored(spark, d))


@query("transition_summary")
def _(spark, d):
    return profile.transition_summary(panel(spark, d))


# -- windows ---------------------------------------------------------------


@query("zscore_by_season_group")
def _(spark, d):
    rows = base(spark, d).select(*KEYS, "metric_raw")
    return windows.zscore_by_season_group(rows, stage=stage)


@query("prev_team")
def _(spark, d):
    return windows.prev_team(base(spark, d)).select(*KEYS, "team", "prev_team")


@query("team_change_flag")
def _(spark, d):
    rows = windows.team_change_flag(windows.prev_team(base(spark, d)))
    return rows.select(*KEYS, "changed_team")


@query("cumulative_moves")
def _(spark, d):
    return moves(spark, d).select(*KEYS, "changed_team", "years_since_change")


@query("first_transition")
def _(spark, d):
    return windows.first_transition(moves(spark, d))


@query("rolling_mean")
def _(spark, d):
    rows = windows.rolling_mean(windows.rolling_mean(panel(spark, d), 2), 3)
    return rows.select(*KEYS, "z_score_roll2", "z_score_roll3")


@query("rolling_volatility")
def _(spark, d):
    rows = windows.rolling_volatility(windows.rolling_volatility(panel(spark, d), 2), 3)
    return rows.select(*KEYS, "z_score_vol2", "z_score_vol3")


@query("momentum")
def _(spark, d):
    return windows.momentum(panel(spark, d)).select(*KEYS, "z_score_momentum")


@query("acceleration")
def _(spark, d):
    rows = windows.acceleration(windows.momentum(panel(spark, d)))
    return rows.select(*KEYS, "z_score_acceleration")


@query("cumulative_change")
def _(spark, d):
    rows = windows.cumulative_change(panel(spark, d))
    return rows.select(*KEYS, "z_score_cumulative_change")


@query("entity_volatility")
def _(spark, d):
    return windows.entity_volatility(panel(spark, d)).select(*KEYS, "performance_variance")


@query("impute_group_median")
def _(spark, d):
    rows = clean.impute_group_median(panel(spark, d), MEASURES, stage=stage)
    return rows.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in MEASURES])


# -- order and shape -------------------------------------------------------


@query("sort_entity_season")
def _(spark, d):
    rows = panel(spark, d).select(*KEYS, "rel_time", "z_score")
    return filters.sort_entity_season(rows, tie_break=[X.ordinal("position_group")])


@query("union_positions")
def _(spark, d):
    rows = regular(spark, d)
    tables = [metrics.efficiency(rows, role) for role in fx.roles("flags")]
    return metrics.union_positions(*tables)


@query("distinct_pairs")
def _(spark, d):
    return clean.distinct_pairs(single(spark, d), ["gsis_id", "pre_trend_slope"])


@query("drop_duplicates")
def _(spark, d):
    return clean.drop_duplicates(_repeating(spark, d))


@query("append_dummy_columns")
def _(spark, d):
    rows = panel(spark, d).select(*KEYS, "team")
    return encode.append_dummy_columns(rows, "team", ["1-URGENT", "2-HIGH"], "unit")


@query("distinct_entities")
def _(spark, d):
    return clean.distinct_entities(panel(spark, d))


# -- scalar functions ------------------------------------------------------


@query("age_on_season_start")
def _(spark, d):
    return P.roster_with_age(fx.roster(spark, d))


@query("relative_time")
def _(spark, d):
    rel = X.relative_time("season", "transition_season")
    return panel(spark, d).select(*KEYS, rel.alias("rel"))


@query("phase_label")
def _(spark, d):
    return panel(spark, d).select(
        *KEYS, X.post_flag("rel_time").alias("post"), X.phase_label("rel_time").alias("label")
    )


@query("team_quality")
def _(spark, d):
    quality = X.team_quality(
        F.col("position_group"), F.col("team_pass_epa_per_play"), F.col("team_sack_rate")
    )
    return panel(spark, d).select(*KEYS, quality.alias("quality"))


@query("scaled_metric")
def _(spark, d):
    scaled = X.scaled_metric("metric_raw", "sd_season")
    return panel(spark, d).select(*KEYS, scaled.alias("metric_raw_scaled"))


@query("performance_level")
def _(spark, d):
    return panel(spark, d).select(*KEYS, X.performance_level("z_score").alias("performance_level"))


@query("career_phase")
def _(spark, d):
    return base(spark, d).select(*KEYS, X.career_phase("years_exp").alias("career_phase"))


@query("exp_group")
def _(spark, d):
    return base(spark, d).select(*KEYS, X.exp_group("years_exp").alias("exp_group"))


@query("pre_trend_category")
def _(spark, d):
    category = X.pre_trend_category("pre_trend_slope")
    return panel(spark, d).select(*KEYS, category.alias("pre_trend_category"))


@query("adjustment_phase")
def _(spark, d):
    phase = X.adjustment_phase("years_since_change")
    return panel(spark, d).select(*KEYS, phase.alias("adjustment_phase"))


@query("clip_outliers")
def _(spark, d):
    rows = panel(spark, d)
    bounds = clean.fence_bounds(clean.quartile_fences(rows, MEASURES, width=0.5))
    rows = clean.clip_outliers(rows, bounds)
    return rows.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in MEASURES])


@query("polynomial_terms")
def _(spark, d):
    rows = features.trajectory_features(base(spark, d))
    return rows.select(*KEYS, "age_squared", "age_cubed", "exp_squared")


@query("exp_decay")
def _(spark, d):
    return panel(spark, d).select(*KEYS, X.exp_decay("age").alias("age_exp_decay"))


@query("peak_distance")
def _(spark, d):
    return panel(spark, d).select(*KEYS, X.peak_distance("years_exp").alias("peak_years_away"))


@query("contract_year_flag")
def _(spark, d):
    flag = X.contract_year_flag("position_group", "years_exp")
    return base(spark, d).select(*KEYS, flag.alias("likely_contract_year"))


@query("interaction_terms")
def _(spark, d):
    rows = features.interaction_features(panel(spark, d))
    return rows.select(
        *KEYS, "age_post_interaction", "exp_post_interaction", "quality_performance_interaction"
    )


@query("position_post_indicators")
def _(spark, d):
    rows = features.interaction_features(panel(spark, d))
    return rows.select(*KEYS, "QB_post", "RB_post", "WR_TE_post")


@query("split_label")
def _(spark, d):
    return split.time_split(panel(spark, d), train_before=-1, validation_to=0).select(
        *KEYS, "rel_time", "data_split"
    )


@query("trajectory_copy")
def _(spark, d):
    rows = features.propensity_features(panel(spark, d))
    return rows.select(
        *KEYS, "performance_trajectory", "performance_variance", "likely_contract_year"
    )


@query("fill_zero")
def _(spark, d):
    rows = clean.fill_zero(panel(spark, d), MEASURES)
    return rows.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in MEASURES])


@query("impute_mode")
def _(spark, d):
    return clean.impute_mode(moves(spark, d), fx.LABELS).select(*KEYS, *fx.LABELS)


@query("residual_columns")
def _(spark, d):
    return scored(spark, d)


# -- encoding, scaling, splitting, reduction -------------------------------

@query("standardize")
def _(spark, d):
    return encode.standardize(panel(spark, d), MEASURES).select(*KEYS, *MEASURES)


@query("one_hot")
def _(spark, d):
    rows = panel(spark, d).select("gsis_id", "season", "position_group", "team")
    return encode.one_hot(encode.one_hot(rows, "position_group"), "team")


@query("label_encode")
def _(spark, d):
    order = ["season", X.ordinal("position_group").alias("o"), "gsis_id"]
    rows = encode.label_encode(moves(spark, d), "gsis_id", order)
    return rows.select(*KEYS, "gsis_id_encoded")


@query("target_encode")
def _(spark, d):
    rows = features.target_encoded_features(panel(spark, d))
    return rows.select(*KEYS, "team_encoded", "position_encoded")


def _pca(spark, d):
    rows = features.enrich(panel(spark, d))
    columns = filters.numeric_columns(rows, filters.FEATURE_EXCLUDED)
    return rows, columns, encode.fit_pca(rows, columns)


@query("pca_scores")
def _(spark, d):
    rows, columns, fitted = _pca(spark, d)
    return encode.pca_scores(rows, columns, KEYS, fitted=fitted)


@query("pca_explained_variance")
def _(spark, d):
    _, _, (_, model) = _pca(spark, d)
    return encode.pca_explained_variance(spark, model)


@query("random_split")
def _(spark, d):
    return split.random_split(panel(spark, d).drop("rel_time"), KEYS).select(*KEYS, "data_split")


@query("entity_holdout_split")
def _(spark, d):
    return split.entity_holdout_split(panel(spark, d)).select(*KEYS, "data_split")


@query("feature_metadata")
def _(spark, d):
    return profile.feature_metadata(features.master_features(panel(spark, d), "copy"), places=DISTINCT_PLACES)


@query("orthogonal_poly2")
def _(spark, d):
    rows = encode.orthogonal_poly2(base(spark, d), "age")
    return rows.select(*KEYS, "age_poly1", "age_poly2")


@query("master_features")
def _(spark, d):
    return features.master_features(panel(spark, d))


PREPROCESSED = (
    "metric_raw", "success_rate", "team_quality", "age", "pre_trend_category",
    "exp_group", "adjustment_phase", "quality_performance_interaction", "data_split",
)


@query("preprocess_panel")
def _(spark, d):
    return features.preprocess(features.enrich(panel(spark, d)))


@query("preprocess_train_test")
def _(spark, d):
    """Fitted on one part of the entities, applied to all rows."""
    rows = features.enrich(panel(spark, d))
    fitted, _ = features.fit_preprocess(
        rows.filter(F.col("season") < 1999), "reference", one_hot=["position_group"], labels=["team"]
    )
    return fitted.apply(rows).select(*KEYS, *PREPROCESSED, "position_group_RB", "position_group_WR_TE", "team_encoded")


# -- predictive models -----------------------------------------------------

_objects: dict[tuple, object] = {}


def _once(spark, key: tuple, build: Callable[[], object]):
    """Fitted models are shared by the queries that read them."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _objects:
        _objects[key] = build()
    return _objects[key]


def _model_rows(spark, d):
    def build():
        rows = features.preprocess(features.enrich(panel(spark, d)))
        rows = split.entity_holdout_split(rows)
        return R.model_frame(rows, R.feature_columns(rows))

    return fx.shared(spark, ("model_rows", d), build)


def _train_test(spark, d):
    rows = _model_rows(spark, d)
    train = filters.filter_isin(rows, "data_split", ["train"])
    return train, filters.filter_isin(rows, "data_split", ["test"]), R.feature_columns(rows)


def _model(spark, d, name):
    def build():
        train, _, columns = _train_test(spark, d)
        return R.MODELS[name](train, columns)

    return _once(spark, ("model", name, d), build)


def _models(spark, d):
    key = lambda name: (spark.sparkContext.applicationId, "model", name, d)
    train, _, columns = _train_test(spark, d)
    # the longest first
    missing = [name for name in reversed(R.MODELS) if key(name) not in _objects]
    for name, model in R.fit_models(train, columns, missing).items() if missing else ():
        _objects[key(name)] = model
    return {name: _objects[key(name)] for name in R.MODELS}


def _comparison(spark, d):
    _, test, _ = _train_test(spark, d)
    return R.compare(_models(spark, d), test)


def _best(spark, d):
    return _model(spark, d, R.rank_models(_comparison(spark, d)).first()["model"])


def _single_model(name):
    def run(spark, d):
        _, test, _ = _train_test(spark, d)
        return R.predictions(_model(spark, d, name), test, keys=KEYS)

    return run


for _key, _name in (
    ("ridge", "Ridge"),
    ("lasso", "Lasso"),
    ("elastic_net", "ElasticNet"),
    ("random_forest", "Random Forest"),
    ("gradient_boosting", "Gradient Boosting"),
    ("boosting_depth6", "Boosting Depth 6"),
):
    query(_key)(_single_model(_name))


@query("model_comparison")
def _(spark, d):
    return _comparison(spark, d)


@query("rank_models")
def _(spark, d):
    return R.rank_models(_comparison(spark, d))


@query("feature_importance")
def _(spark, d):
    return R.feature_importance(_best(spark, d), spark)


@query("topk_features")
def _(spark, d):
    return R.topk_features(R.feature_importance(_best(spark, d), spark), 15)


@query("predictions")
def _(spark, d):
    _, test, _ = _train_test(spark, d)
    return R.predictions(_best(spark, d), test, keys=KEYS)


@query("save_load_model")
def _(spark, d):
    _, test, _ = _train_test(spark, d)
    path = stage_path(spark, "model")
    R.save_model(_best(spark, d), path)
    return R.predictions(R.load_model(path), test, keys=KEYS)


# -- mixed models ----------------------------------------------------------


def _effect_rows(spark, d):
    return effects.model_rows(single(spark, d))


def _fitted(spark, d, name) -> mixed.MixedModel:
    builders = {
        "null": lambda: effects.null_model(single(spark, d)),
        "covariates": lambda: effects.covariate_model(_effect_rows(spark, d)),
        "slope": lambda: effects.slope_model(_effect_rows(spark, d)),
        "phases": lambda: effects.phase_model(single(spark, d)),
        "equal": lambda: effects.phase_model(single(spark, d), by_phase=False),
        "interaction": lambda: effects.interaction_model(_effect_rows(spark, d)),
    }
    return _once(spark, ("lmm", name, d), builders[name])


@query("icc_null_model")
def _(spark, d):
    return mixed.anova_icc(single(spark, d))


@query("icc_null_model_reml")
def _(spark, d):
    return mixed.variance_table(_fitted(spark, d, "null"), spark)


def _tables(name):
    def run(spark, d):
        model = _fitted(spark, d, name)
        fixed = mixed.fixed_effect_table(model, spark).select("term", "estimate", "std_error")
        spread = mixed.variance_table(model, spark)
        return fixed.unionByName(
            spread.select(
                F.col("component").alias("term"),
                F.col("value").alias("estimate"),
                F.lit(None).cast("double").alias("std_error"),
            )
        )

    return run


for _key, _name in (
    ("lmm_fixed", "covariates"),
    ("lmm_random_slope", "slope"),
    ("lmm_heteroskedastic", "phases"),
    ("lmm_interaction", "interaction"),
):
    query(_key)(_tables(_name))


@query("likelihood_ratio")
def _(spark, d):
    return mixed.likelihood_ratio(_fitted(spark, d, "phases"), _fitted(spark, d, "equal"), spark)


@query("random_effects")
def _(spark, d):
    return mixed.random_effects(_fitted(spark, d, "interaction"))


def _residuals(spark, d):
    model = _fitted(spark, d, "interaction")
    return mixed.fitted_residuals(model, _effect_rows(spark, d))


@query("fitted_residuals")
def _(spark, d):
    return _residuals(spark, d)


@query("marginal_effects")
def _(spark, d):
    return effects.marginal_effects(_fitted(spark, d, "interaction"), _effect_rows(spark, d))


@query("fixed_effect_table")
def _(spark, d):
    return mixed.fixed_effect_table(_fitted(spark, d, "interaction"), spark)


@query("scaled_residuals")
def _(spark, d):
    return mixed.scaled_residuals(_fitted(spark, d, "interaction"), _effect_rows(spark, d))


# -- chart tables ----------------------------------------------------------


@query("trajectory_by_position")
def _(spark, d):
    return charts.trajectory_by_position(single(spark, d))


@query("trajectory_loess")
def _(spark, d):
    return smooth.loess(single(spark, d))


@query("boxplot_stats")
def _(spark, d):
    return charts.boxplot_stats(panel(spark, d))


@query("trend_lines")
def _(spark, d):
    return charts.trend_lines(charts.pre_post_change(single(spark, d)))


@query("intercept_trend_line")
def _(spark, d):
    model = _fitted(spark, d, "interaction")
    rows = joins.join_distinct_effects(single(spark, d), mixed.random_effects(model))
    return charts.trend_lines(rows, by=(), y="intercept")


@query("qq_points")
def _(spark, d):
    return charts.qq_points(scored(spark, d), "error")


@query("qq_points_mixed")
def _(spark, d):
    return charts.qq_points(_residuals(spark, d), exact=False)


@query("residual_vs_fitted")
def _(spark, d):
    return charts.residual_vs_fitted(scored(spark, d))


@query("residual_spline")
def _(spark, d):
    return smooth.spline_curve(scored(spark, d))


@query("error_histogram")
def _(spark, d):
    return charts.error_histogram(scored(spark, d))


@query("prediction_range")
def _(spark, d):
    return charts.prediction_range(scored(spark, d))


@query("transition_effect")
def _(spark, d):
    # Needs neither team context nor pre-trend: straight from the base table.
    return P.transition_effect(P.relative_panel(fx.base(spark, d, "single")))


@query("transition_panel")
def _(spark, d):
    return panel(spark, d)
