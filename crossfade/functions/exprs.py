"""Scalar expressions (F1-F22). All are built-in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Group labels, bin edges and labels of the panel's categories.
GROUPS = ("RB", "WR_TE", "QB")
PERFORMANCE_EDGES = (-1.0, 0.0, 1.0)
PERFORMANCE_LABELS = ("Below Avg", "Average", "Above Avg", "Elite")
CAREER_EDGES = (3.0, 7.0, 12.0)
CAREER_LABELS = ("Early", "Prime", "Veteran", "Late Career")
EXPERIENCE_LABELS = ("Rookie", "Early Career", "Prime", "Veteran")
TREND_EDGES = (-0.05, 0.05)
TREND_LABELS = ("Declining", "Stable", "Improving")
ADJUSTMENT_EDGES = (1, 3)
ADJUSTMENT_LABELS = ("Transition", "Adjustment", "Established")
CONTRACT_YEARS = {"RB": (6, 7, 8), "QB": (7, 8, 9)}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordinal(group: Column | str, order: Sequence[str] = GROUPS) -> Column:
    """Position of a label in a fixed list: the tie-break inside one season."""
    return F.array_position(F.array(*[F.lit(g) for g in order]), _col(group))


def age_on_season_start(
    season: Column | str, birth: Column | str, month: int = 9, day: int = 1
) -> Column:
    """Years from birth to a fixed day of the season."""
    start = F.make_date(_col(season), F.lit(month), F.lit(day))
    return F.datediff(start, _col(birth)) / F.lit(365.25)


def relative_time(time: Column | str, event_time: Column | str) -> Column:
    return _col(time) - _col(event_time)


def post_flag(rel: Column | str) -> Column:
    """1 from the event on, 0 before it."""
    return F.when(_col(rel) >= 0, 1).when(_col(rel) < 0, 0)


def phase_label(rel: Column | str) -> Column:
    return F.when(_col(rel) < 0, "Pre").when(_col(rel) >= 0, "Post")


def team_quality(group: Column, pass_value: Column, sack_rate: Column) -> Column:
    """Supporting-cast quality by group; 0 where nothing is known."""
    value = (
        F.when(group.isin("RB", "WR_TE"), pass_value)
        .when(group == "QB", -sack_rate)
        .otherwise(F.lit(0.0))
    )
    return F.coalesce(value, F.lit(0.0))


def scaled_metric(metric: Column | str, sd: Column | str, eps: float = 1e-10) -> Column:
    return F.try_divide(_col(metric), _col(sd) + F.lit(eps))


def cut(
    value: Column | str,
    edges: Sequence[float],
    labels: Sequence[str],
    lower: float | None = None,
) -> Column:
    """Right-closed bins: ``labels[i]`` up to and including ``edges[i]``.

    Values at or below ``lower`` belong to no bin.
    """
    value = _col(value)
    ladder = F.when(value.isNull(), None)
    if lower is not None:
        ladder = ladder.when(value <= F.lit(lower), None)
    for edge, label in zip(edges, labels):
        ladder = ladder.when(value <= F.lit(edge), label)
    return ladder.otherwise(labels[-1])


def performance_level(z: Column | str) -> Column:
    return cut(z, PERFORMANCE_EDGES, PERFORMANCE_LABELS)


def career_phase(exp: Column | str) -> Column:
    return cut(exp, CAREER_EDGES, CAREER_LABELS, lower=0.0)


def exp_group(exp: Column | str) -> Column:
    return cut(exp, CAREER_EDGES, EXPERIENCE_LABELS, lower=0.0)


def pre_trend_category(slope: Column | str) -> Column:
    return cut(slope, TREND_EDGES, TREND_LABELS)


def adjustment_phase(
    moves: Column | str,
    edges: Sequence[int] = ADJUSTMENT_EDGES,
    labels: Sequence[str] = ADJUSTMENT_LABELS,
) -> Column:
    """As ``cut``, but a missing value falls into the last label."""
    moves = _col(moves)
    return (
        F.when(moves <= edges[0], labels[0])
        .when(moves <= edges[1], labels[1])
        .otherwise(labels[2])
    )


def clip(value: Column | str, low: Column | float, high: Column | float) -> Column:
    """Cap at the bounds and keep NULL (greatest/least would replace it)."""
    value = _col(value)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def power(value: Column | str, degree: int) -> Column:
    """Integer power as repeated multiplication."""
    value = _col(value)
    return reduce(lambda acc, _: acc * value, range(degree - 1), value)


def exp_decay(value: Column | str, rate: float = 0.1) -> Column:
    return F.exp(_col(value) * F.lit(-rate))


def peak_distance(exp: Column | str, peak: int = 5) -> Column:
    return _col(exp) - F.lit(peak)


def contract_year_flag(
    group: Column | str,
    exp: Column | str,
    years: Mapping[str, Sequence[int]] = CONTRACT_YEARS,
) -> Column:
    hits = [(_col(group) == g) & _col(exp).isin(list(y)) for g, y in years.items()]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False)).cast("int")


def interaction(left: Column | str, right: Column | str) -> Column:
    return _col(left) * _col(right)


def split_label(
    rel: Column | str, train_before: int = -2, validation_to: int = 0
) -> Column:
    """Split by relative time; a missing time is a test row."""
    rel = _col(rel)
    return (
        F.when(rel < train_before, "train")
        .when(rel <= validation_to, "validation")
        .otherwise("test")
    )


def trend_slope(y: Column | str, x: Column | str, where: Column) -> Column:
    """Least-squares slope over the rows of ``where``; NULL for fewer than two
    points. Works as an aggregate or over a window.
    """
    return F.regr_slope(F.when(where, _col(y)), F.when(where, _col(x)))
