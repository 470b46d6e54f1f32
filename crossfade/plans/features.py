"""Enrichment, preprocessing and the joined feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossfade.functions import exprs as X
from crossfade.operators import clean, encode, filters, split, windows
from crossfade.operators.quantiles import medians, quantiles
from crossfade.sources.staging import Stager
from crossfade.sources.staging import stage as write_stage


def enrich(panel: DataFrame) -> DataFrame:
    """Scaled metric, performance level, career phase, squared age."""
    return panel.withColumns(
        {
            "metric_raw_scaled": X.scaled_metric("metric_raw", "sd_season"),
            "performance_level": X.performance_level("z_score"),
            "career_phase": X.career_phase("years_exp"),
            "age_squared": X.power("age", 2),
        }
    )


def derived(df: DataFrame) -> DataFrame:
    """Trend category, quality x metric, experience group, adjustment phase."""
    return df.withColumns(
        {
            "pre_trend_category": X.pre_trend_category("pre_trend_slope"),
            "quality_performance_interaction": X.interaction("team_quality", "z_score"),
            "exp_group": X.exp_group("years_exp"),
            "adjustment_phase": X.adjustment_phase("years_since_change"),
        }
    )


@dataclass(frozen=True)
class Preprocessing:
    """What preprocessing has learned from its rows; see :func:`fit_preprocess`."""

    order: str
    medians: DataFrame
    modes: Mapping[str, str]
    bounds: Mapping[str, tuple]
    scaling: DataFrame
    indicators: Mapping[str, list]  # column -> values with a 0/1 column each
    codes: Mapping[str, DataFrame]  # column -> (value, code)

    def apply(self, enriched: DataFrame) -> DataFrame:
        """Impute, cap, scale, derive, encode and split other rows alike.

        Rows are neither dropped nor learned from. A value that the fit did
        not see has no indicator, and -1 as its code.
        """
        return self._finish(self._impute(enriched))

    def _impute(self, enriched: DataFrame) -> DataFrame:
        return clean.apply_group_median(enriched, self.medians).fillna(dict(self.modes))

    def _finish(self, imputed: DataFrame) -> DataFrame:
        out = clean.clip_outliers(imputed, self.bounds)
        if self.order == "raw":
            out = derived(out)
        out = encode.apply_standardize(out, self.scaling)
        if self.order == "reference":
            out = derived(out)
        return split.time_split(self._encode(out))

    def _encode(self, out: DataFrame) -> DataFrame:
        for column, values in self.indicators.items():
            out = encode.append_dummy_columns(out, column, values)
        for column, codes in self.codes.items():
            out = encode.apply_label_encode(out, codes, column)
        return out


def fit_preprocess(
    enriched: DataFrame,
    order: str = "raw",
    clip_columns: Sequence[str] | None = None,
    mode_columns: Sequence[str] | None = None,
    one_hot: Sequence[str] = (),
    labels: Sequence[str] = (),
    stage: Stager = write_stage,
) -> tuple[Preprocessing, DataFrame]:
    """Learn preprocessing from rows, and give these rows preprocessed.

    Missing values are filled, repeated rows dropped, outliers capped, numbers
    scaled, categories derived and encoded (``one_hot`` as indicators of all
    but the first value, ``labels`` as codes by first appearance in the order
    of the values), and rows split by time.

    ``order="raw"`` derives the categories from raw units and scales after;
    it caps ``clip_columns`` (those to be scaled by default).
    ``order="reference"`` caps every numeric column and scales first, so the
    category thresholds meet standardised values.
    """
    if order not in ("raw", "reference"):
        raise ValueError(f"unknown order: {order}")
    numeric = filters.numeric_columns(enriched)
    scaled = [c for c in numeric if c not in filters.SCALING_EXCLUDED]
    # The season is a key: never missing, and to stay an integer.
    fillable = [c for c in numeric if c != "season"]
    medians_ = clean.fit_group_median(enriched, fillable, stage=stage)
    strings = mode_columns or filters.string_columns(
        enriched, ["performance_level", "career_phase"]
    )
    found = {r["column_name"]: r["mode"] for r in clean.column_mode(enriched, strings).collect()}
    modes = {c: found.get(c, "Unknown") for c in strings}
    imputed = clean.apply_group_median(enriched, medians_).fillna(modes)
    # Quartiles, moments and the result each read the imputed rows.
    unique = stage(clean.drop_duplicates(imputed), "imputed")
    capped = list(numeric if order == "reference" else (clip_columns or scaled))
    wanted = list(dict.fromkeys([*capped, *scaled]))
    quarters = quantiles(unique, wanted, [0.25, 0.5, 0.75]).first()
    bounds = {c: clean.fences(*quarters[c][::2]) for c in capped if quarters[c]}
    # A median lies inside the fences, so capping leaves it as it is.
    middle = {c: quarters[c][1] if quarters[c] else None for c in scaled}
    scaling = stage(encode.fit_standardize(clean.clip_outliers(unique, bounds), scaled, middle), "scaling")
    fitted = Preprocessing(order, medians_, modes, bounds, scaling, {}, {})
    if one_hot or labels:
        rows = stage(fitted._finish(unique), "derived")
        indicators = {}
        for c in one_hot:
            values = encode.levels(rows, c)
            if values is None:
                raise ValueError(f"{c} has too many values for indicators; use labels")
            indicators[c] = values[1:]
        codes = {c: stage(encode.fit_label_encode(rows, c, [c]), "codes") for c in labels}
        fitted = replace(fitted, indicators=indicators, codes=codes)
    return fitted, fitted._finish(unique)


def preprocess(enriched: DataFrame, order: str = "raw", **options) -> DataFrame:
    """Rows preprocessed with what they teach themselves; see :func:`fit_preprocess`."""
    return fit_preprocess(enriched, order, **options)[1]


def propensity_features(df: DataFrame) -> DataFrame:
    """Pre-trend copy, entity volatility, contract-year flag."""
    out = df.withColumn("performance_trajectory", F.col("pre_trend_slope"))
    out = windows.entity_volatility(out)
    return out.withColumn(
        "likely_contract_year", X.contract_year_flag("position_group", "years_exp")
    )


def age_features(df: DataFrame, median_age: float) -> DataFrame:
    """Powers of the filled age, its decay, and experience terms."""
    age = F.coalesce(F.col("age"), F.lit(median_age))
    return df.withColumns(
        {
            "age_squared": X.power(age, 2),
            "age_cubed": X.power(age, 3),
            "age_exp_decay": X.exp_decay("age"),
            "exp_squared": X.power("years_exp", 2),
            "peak_years_away": X.peak_distance("years_exp"),
        }
    )


def trajectory_features(df: DataFrame, **options) -> DataFrame:
    return age_features(df, medians(df, ["age"], **options).first()["age"])


def _sequence_window():
    return Window.partitionBy("gsis_id").orderBy("season", "_ordinal")


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumn("_ordinal", X.ordinal("position_group"))


def rolling_features(df: DataFrame, widths: Sequence[int] = (2, 3)) -> DataFrame:
    """Rolling mean and deviation per width, over one sort."""
    out = _ordered(df)
    for width in widths:
        out = windows.rolling_mean(out, width, window=_sequence_window())
        out = windows.rolling_volatility(out, width, window=_sequence_window())
    return out.drop("_ordinal")


def momentum_features(df: DataFrame) -> DataFrame:
    """Momentum, acceleration and cumulative change, over one sort."""
    out = _ordered(df)
    for step in (windows.momentum, windows.acceleration, windows.cumulative_change):
        out = step(out, window=_sequence_window())
    return out.drop("_ordinal")


def position_post_indicators(
    df: DataFrame, positions: Sequence[str], post: str = "post_transition"
) -> list[Column]:
    """(group == p) x post for each given group."""
    hit = lambda p: F.coalesce(F.col("position_group") == p, F.lit(False)).cast("int")
    return [(hit(p) * F.col(post)).alias(f"{p}_post") for p in positions]


def first_positions(df: DataFrame, n: int | None = None) -> list[str]:
    """The groups in sorted order: all of them, or the first ``n``.

    Each becomes a column, so these are labels of which there are few.
    """
    rows = df.select("position_group").distinct().dropna().orderBy("position_group")
    return [r[0] for r in (rows if n is None else rows.limit(n)).collect()]


def interaction_features(df: DataFrame, positions: Sequence[str] | None = None) -> DataFrame:
    positions = first_positions(df) if positions is None else positions
    return df.withColumns(
        {
            "age_post_interaction": X.interaction("age", "post_transition"),
            "exp_post_interaction": X.interaction("years_exp", "post_transition"),
            "quality_performance_interaction": X.interaction("team_quality", "z_score"),
        }
    ).select("*", *position_post_indicators(df, positions))


def target_encoded_features(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    out = encode.target_encode(df, "team", smoothing=5.0, out="team_encoded", fit_on=fit_on)
    return encode.target_encode(
        out, "position_group", smoothing=10.0, out="position_encoded",
        fit_on=df if fit_on is None else fit_on,
    )


def master_features(
    df: DataFrame,
    mode: str = "joined",
    fit_on: DataFrame | None = None,
    pca_columns: Sequence[str] | None = None,
) -> DataFrame:
    """The feature table.

    ``mode="copy"`` is the panel as it is. ``mode="joined"`` adds all feature
    families; they are columns of the same rows, so nothing is joined but the
    category means. ``pca_columns`` adds component scores of those columns.
    """
    if mode == "copy":
        return df
    if mode != "joined":
        raise ValueError(f"unknown mode: {mode}")
    out = target_encoded_features(df, fit_on)
    out = interaction_features(trajectory_features(out))
    out = momentum_features(rolling_features(out))
    out = propensity_features(out)
    if pca_columns:
        keys = out.columns
        out = encode.pca_scores(out, pca_columns, keys)
    return out
