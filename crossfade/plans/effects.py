"""The series of mixed models of the change around the move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfade.models import mixed
from crossfade.operators.encode import fit_orthogonal_poly2, orthogonal_poly2


def model_rows(panel: DataFrame) -> DataFrame:
    """Panel rows with an age, and the orthogonal age terms over them."""
    return orthogonal_poly2(panel.filter(F.col("age").isNotNull()), "age")


def _terms(*names: str) -> dict:
    return {n: F.col(n) for n in names}


def null_model(panel: DataFrame) -> mixed.MixedModel:
    return mixed.fit_lmm(panel, "z_score", {})


def covariate_model(rows: DataFrame) -> mixed.MixedModel:
    """Fixed covariates and a random intercept."""
    fixed = _terms(
        "post_transition", "age_poly1", "age_poly2", "years_exp", "team_quality",
        "pre_trend_slope",
    )
    return mixed.fit_lmm(rows, "z_score", fixed)


def slope_model(rows: DataFrame) -> mixed.MixedModel:
    """A random slope in relative time."""
    fixed = _terms("post_transition", "age_poly1", "age_poly2", "years_exp", "team_quality")
    return mixed.fit_lmm(rows, "z_score", fixed, slope="rel_time")


def phase_model(panel: DataFrame, by_phase: bool = True) -> mixed.MixedModel:
    """Residual variance per phase, or the same model with an equal one."""
    return mixed.fit_lmm(
        panel,
        "z_score",
        _terms("post_transition", "years_exp"),
        slope="rel_time",
        phase="post_transition" if by_phase else None,
    )


GROUP_TERMS = {"RB": "position_groupRB", "WR_TE": "position_groupWR_TE"}
INTERACTIONS = {
    "RB": "post_transition:position_groupRB",
    "WR_TE": "post_transition:position_groupWR_TE",
}


def interaction_model(rows: DataFrame) -> mixed.MixedModel:
    """The move's effect by group; QB, first in the alphabet, is the baseline."""
    group = {
        term: (F.col("position_group") == g).cast("int") for g, term in GROUP_TERMS.items()
    }
    fixed = {
        **_terms("post_transition"),
        **group,
        **_terms("age_poly1", "age_poly2", "years_exp", "team_quality"),
        **{INTERACTIONS[g]: group[term] * F.col("post_transition") for g, term in GROUP_TERMS.items()},
    }
    return mixed.fit_lmm(rows, "z_score", fixed, slope="rel_time")


def marginal_effects(model: mixed.MixedModel, rows: DataFrame) -> DataFrame:
    """Adjusted predictions by group before and after the move, at the mean age."""
    complete = rows.dropna(subset=["z_score", "age", "years_exp", "team_quality"])
    age = complete.agg(F.avg("age").alias("age"))
    at = orthogonal_poly2(age, "age", fit_orthogonal_poly2(rows, "age")).first()
    held = {n: at[n] for n in ("age_poly1", "age_poly2")}
    return mixed.marginal_effects(
        model, rows, "post_transition", ("QB", "RB", "WR_TE"), GROUP_TERMS, INTERACTIONS, held
    )
