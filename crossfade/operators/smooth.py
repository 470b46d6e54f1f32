"""Smoothers behind the charts (V1, V6): local regression and a penalised spline.

Both read the rows only as sums. A local regression weighs rows by their
distance from a point, which equal x values share, so rows are first summed by
x; each point's neighbourhood, its weighted moments and the residuals are then
aggregations over those sums. The spline needs its basis' cross products, which
are sums by interval between knots.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossfade.operators.joins import attach
from crossfade.operators.quantiles import quantiles
from crossfade.sources.staging import stage

#: Parts into which a round cuts the distances that may hold the wanted one.
_PARTS = 256
_MOMENTS = [f"s{k}" for k in range(5)] + [f"t{k}" for k in range(3)] + [f"q{k}" for k in range(5)]


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's distribution for ``p`` above one half, by Newton steps on its integral."""
    from math import lgamma, pi

    log_scale = lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * np.log(df * pi)
    density = lambda t: np.exp(log_scale - (df + 1) / 2 * np.log1p(t * t / df))
    nodes = np.linspace(0, 1, 4001)
    simpson = np.ones(4001)
    simpson[1:-1:2], simpson[2:-1:2] = 4, 2
    t = NormalDist().inv_cdf(p)
    for _ in range(200):  # concave above zero, so steps never pass the root
        # the integral over log(1 + t), in which heavy tails are smooth
        s = nodes * np.log1p(t)
        area = (simpson * density(np.expm1(s)) * np.exp(s)).sum() * np.log1p(t) / 12000
        step = (p - 0.5 - area) / density(t)
        t += step
        if abs(step) < 1e-13 * t:
            break
    return float(t)


def _tricube(x: Column, at: Column) -> Column:
    """The weight of ``x`` for the point ``at``; rows at the point itself if its neighbourhood has no width."""
    u = F.abs(x - at["v"]) / at["h"]
    return F.when(at["h"] == 0, (x == at["v"]).cast("double")).when(u < 1, F.pow(1 - u * u * u, 3)).otherwise(0.0)


def _scaled(x: Column, at: Column) -> Column:
    return F.when(at["h"] == 0, 0.0).otherwise((x - at["v"]) / at["h"])


def _widths(cells: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with ``h``, the distance of the ``rank``-th nearest row.

    Distances are counted in equal parts of the range that may hold the wanted
    one, which then shrinks to the least and greatest distance of its part; a
    point is done when these are one value. Rounds take no sort, and what they
    leave is one row per point and part.
    """
    far = F.greatest(F.col("v") - F.col("low"), F.col("high") - F.col("v"))
    state = points.select(*keys, "i", "v", "rank", F.lit(0.0).alias("least"), far.alias("most"))
    while True:
        state = stage(state, "loess-state")
        open_ = state.filter(F.col("least") < F.col("most"))
        if open_.isEmpty():
            return state.withColumnRenamed("least", "h").drop("rank", "most")
        asked = stage(open_.groupBy(*keys).agg(F.collect_list(F.struct("i", "v", "least", "most")).alias("at")), "loess-open")
        met = attach(cells.select(*keys, "x", "n"), asked, keys, "inner").select(*keys, "x", "n", F.inline("at"))
        met = met.withColumn("d", F.abs(F.col("x") - F.col("v"))).filter(F.col("d").between(F.col("least"), F.col("most")))
        part = F.least(F.floor((F.col("d") - F.col("least")) / (F.col("most") - F.col("least")) * _PARTS), F.lit(_PARTS - 1))
        counts = met.groupBy(*keys, "i", part.alias("part")).agg(F.sum("n").alias("rows"), F.min("d").alias("new_least"), F.max("d").alias("new_most"))
        upto = F.sum("rows").over(Window.partitionBy(*keys, "i").orderBy("part"))
        counts = stage(counts.withColumn("upto", upto), "loess-parts")
        found = attach(open_.select(*keys, "i", "v", "rank"), counts.withColumnRenamed("i", "of"), keys, "inner").filter(F.col("i") == F.col("of"))
        found = found.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("rows") < F.col("rank")))
        found = found.select(*keys, "i", "v", (F.col("rank") - F.col("upto") + F.col("rows")).alias("rank"), F.col("new_least").alias("least"), F.col("new_most").alias("most"))
        state = state.filter(F.col("least") == F.col("most")).unionByName(found)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds value, slope, variance factor and coefficients of each point's quadratic."""
    for batch in batches:
        named = dict(zip(batch.schema.names, batch.columns))
        s, t, q = (np.stack([named[f"{c}{k}"].to_numpy(zero_copy_only=False) for k in range(n)], axis=1) for c, n in (("s", 5), ("t", 3), ("q", 5)))
        h = named["h"].to_numpy(zero_copy_only=False)
        places = np.add.outer(np.arange(3), np.arange(3))
        # what has too few distinct x gets the shortest solution, as by a pseudo-inverse
        inverse = np.linalg.pinv(s[:, places], rcond=1e-12, hermitian=True)
        value, slope = inverse[:, 0], inverse[:, 1] / np.where(h == 0, np.inf, h)[:, None]
        variance = np.einsum("bi,bij,bj->b", value, q[:, places], value)
        added = [("fit", (value * t).sum(axis=1)), ("slope", (slope * t).sum(axis=1)), ("factor", variance)]
        added += [(f"c{k}", value[:, k]) for k in range(3)] + [(f"d{k}", slope[:, k]) for k in range(3)]
        kept = [c for c in batch.schema.names if c not in _MOMENTS]
        yield pa.RecordBatch.from_arrays([*(named[c] for c in kept), *(pa.array(v) for _, v in added)], [*kept, *(n for n, _ in added)])


def loess(
    df: DataFrame, x: str = "rel_time", y: str = "z_score", by: Sequence[str] = ("position_group",), span: float = 0.75, points: int = 80, level: float = 0.95
) -> DataFrame:
    """``(*by, x, n, fit, se, df, low, high)``: local quadratic regression with its confidence band.

    A point's neighbourhood is the ``span`` nearest of its group's ``n`` rows;
    they weigh by the tricube of their distance over the farthest one's. Points
    are the distinct values of a whole-number ``x`` if there are at most
    ``points``, else that many at equal steps over the range. The fit at a point
    is exact; rows between points are fitted by the cubic with the values and
    slopes on either side, which the residuals and the trace of the smoother
    come from. ``df`` is the rows less that trace, ``se`` the standard error and
    ``low`` to ``high`` its ``level`` interval, NULL without a degree of freedom.
    Rows with a NULL in x or y are left out; NULL keys are a group. A
    neighbourhood of fewer than three x values has the shortest of the fits that
    agree with it.
    """
    if not 0 < span <= 1:
        raise ValueError("span lies above 0 and is 1 at most")
    whole = dict(df.dtypes)[x] in ("tinyint", "smallint", "int", "bigint")
    keys = [f"_k{i}" for i in range(len(by))] or ["_k"]
    names = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias("_k")]
    rows = df.select(*names, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    cells = rows.groupBy(*keys, "x").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("spread"))
    cells = stage(cells, "loess-cells")
    groups = cells.groupBy(*keys).agg(F.sum("n").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("distinct"))
    groups = stage(groups, "loess-groups")
    own = F.lit(whole) & (F.col("distinct") <= points)
    few = attach(cells.select(*keys, "x"), groups.filter(own), keys, "inner").groupBy(*keys, "rows", "low", "high").agg(F.array_sort(F.collect_list("x")).alias("vs"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.when(i == points - 1, F.col("high")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * i / (points - 1)))
    many = groups.filter(~own).select(*keys, "rows", "low", "high", F.array_distinct(steps).alias("vs"))
    rank = F.greatest(F.floor(F.col("rows") * span + 1e-5), F.lit(1))
    at = few.unionByName(many).select(*keys, "low", "high", rank.alias("rank"), F.posexplode("vs").alias("i", "v"))

    at = _widths(cells, at, keys)
    asked = stage(at.groupBy(*keys).agg(F.collect_list(F.struct("i", "v", "h")).alias("at")), "loess-points")
    met = attach(cells, asked, keys, "inner").select(*keys, "x", "n", "mean", F.explode("at").alias("at"))
    w, z = _tricube(F.col("x"), F.col("at")), _scaled(F.col("x"), F.col("at"))
    met = met.withColumns({"w": w, "z": z}).filter(F.col("w") > 0)
    power = lambda k: F.lit(1.0) if k == 0 else F.pow("z", F.lit(float(k)))
    sums = [F.sum(F.col("n") * F.col("w") * power(k)).alias(f"s{k}") for k in range(5)]
    sums += [F.sum(F.col("n") * F.col("mean") * F.col("w") * power(k)).alias(f"t{k}") for k in range(3)]
    sums += [F.sum(F.col("n") * F.col("w") * F.col("w") * power(k)).alias(f"q{k}") for k in range(5)]
    moments = met.groupBy(*keys, "at.i", "at.v", "at.h").agg(*sums)
    numbers = ["fit", "slope", "factor", "c0", "c1", "c2", "d0", "d1", "d2"]
    schema = ", ".join(f"{n} {t}" for n, t in moments.dtypes if n not in _MOMENTS) + "".join(f", {n} double" for n in numbers)
    solved = stage(moments.mapInArrow(_solve, schema), "loess-solved")

    ordered = solved.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v", "h", *numbers))).alias("at"))
    placed = attach(cells, stage(ordered, "loess-curves"), keys, "inner")
    left = F.greatest(F.size(F.filter("at", lambda p: p["v"] <= F.col("x"))), F.lit(1))
    placed = placed.withColumn("a", F.get("at", left - 1)).withColumn("b", F.get("at", F.least(left, F.size("at") - 1))).drop("at")
    gap = F.col("b.v") - F.col("a.v")
    t = F.when(gap == 0, 0.0).otherwise((F.col("x") - F.col("a.v")) / gap)
    placed = placed.withColumns({"gap": gap, "t": t})
    t, gap, x_ = F.col("t"), F.col("gap"), F.col("x")

    def blended(value_a: Column, slope_a: Column, value_b: Column, slope_b: Column) -> Column:
        t2, t3 = t * t, t * t * t
        return (2 * t3 - 3 * t2 + 1) * value_a + (t3 - 2 * t2 + t) * gap * slope_a + (3 * t2 - 2 * t3) * value_b + (t3 - t2) * gap * slope_b

    def own_weight(p: Column, c: str) -> Column:
        z = _scaled(x_, p)
        return _tricube(x_, p) * (p[f"{c}0"] + p[f"{c}1"] * z + p[f"{c}2"] * z * z)

    a, b = F.col("a"), F.col("b")
    fitted = blended(a["fit"], a["slope"], b["fit"], b["slope"])
    leverage = blended(own_weight(a, "c"), own_weight(a, "d"), own_weight(b, "c"), own_weight(b, "d"))
    n = F.col("n")
    total = placed.groupBy(*keys).agg(
        F.sum(n).alias("rows"),
        F.sum(n * F.col("spread") + n * F.pow(F.col("mean") - fitted, F.lit(2.0))).alias("rss"),
        (F.sum(n) - F.sum(n * leverage)).alias("df"),
    )

    def with_t(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t_quantile((1 + level) / 2, d) if d is not None and d > 1e-6 else None for d in batch["df"].to_pylist()]
            yield batch.append_column("t", pa.array(found, pa.float64()))

    total = stage(total.mapInArrow(with_t, ", ".join(f"{c} {k}" for c, k in total.dtypes) + ", t double"), "loess-groups")
    curve = attach(solved.select(*keys, "v", "fit", "factor"), total, keys, "inner")
    se = F.when(F.col("t").isNotNull(), F.sqrt(F.greatest(F.col("rss"), F.lit(0.0)) / F.col("df") * F.greatest(F.col("factor"), F.lit(0.0))))
    curve = curve.withColumn("se", se)
    return curve.select(
        *[F.col(k).alias(b) for b, k in zip(by, keys)], F.col("v").alias(x), F.col("rows").alias("n"), "fit", "se", "df",
        (F.col("fit") - F.col("t") * F.col("se")).alias("low"), (F.col("fit") + F.col("t") * F.col("se")).alias("high"),
    )


def _spline_maps(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(second, penalty)``: second derivatives at the knots, and the integral of their square, from values there."""
    k, gaps = len(knots), np.diff(knots)
    first, second = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
    for i in range(k - 2):
        first[i, i : i + 3] = 1 / gaps[i], -1 / gaps[i] - 1 / gaps[i + 1], 1 / gaps[i + 1]
        second[i, i] = (gaps[i] + gaps[i + 1]) / 3
        if i + 1 < k - 2:
            second[i, i + 1] = second[i + 1, i] = gaps[i + 1] / 6
    inner = np.linalg.solve(second, first)
    return np.vstack([np.zeros(k), inner, np.zeros(k)]), first.T @ inner


def _local(knots: np.ndarray, second: np.ndarray, j: int) -> np.ndarray:
    """Columns of the basis that the four functions of interval ``j`` stand for."""
    k = len(knots)
    return np.stack([np.eye(k)[j], np.eye(k)[j + 1], second[j], second[j + 1]])


def _functions(x, left, right):
    """The functions that weigh values and second derivatives at either end of an interval."""
    gap, a, b = right - left, right - x, x - left
    return a / gap, b / gap, (a * a * a / gap - gap * a) / 6, (b * b * b / gap - gap * b) / 6


def fit_spline(df: DataFrame, x: str = "predicted", y: str = "error", knots: int = 10) -> dict | None:
    """A cubic regression spline whose smoothness has the least generalised cross-validation score.

    Knots are quantiles of the distinct x. The basis' cross products are sums by
    interval: one aggregation over the rows, one row per interval to the driver.
    ``knots``, ``values`` at them, ``penalty``, ``edf`` and ``gcv``; with fewer than three
    distinct x a straight line or a mean; None without a row.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    distinct = rows.select("x").distinct()
    knots = min(knots, distinct.limit(knots).count())
    if not knots:
        return None
    found = quantiles(distinct, ["x"], [i / max(knots - 1, 1) for i in range(knots)]).first()
    at = np.unique(np.array(found["x"]))
    if len(at) < 3:
        line = rows.agg(F.avg("x"), F.avg("y"), F.regr_slope("y", "x"), F.count("y")).first()
        slope = line[2] or 0.0
        return {"knots": at, "values": line[1] + slope * (at - line[0]), "penalty": 0.0, "edf": float(len(at)), "gcv": None}
    middle = rows.agg(F.avg("y")).first()[0]
    inner = [float(v) for v in at[1:-1]]
    j = sum(((F.col("x") >= v).cast("int") for v in inner[1:]), (F.col("x") >= inner[0]).cast("int"))
    ends = F.array(*map(F.lit, map(float, at)))
    placed = rows.select("x", (F.col("y") - middle).alias("y"), j.alias("j")).withColumns({"l": F.get(ends, F.col("j")), "r": F.get(ends, F.col("j") + 1)})
    parts = [*_functions(F.col("x"), F.col("l"), F.col("r")), F.col("y")]
    pairs = [(p, q) for p in range(5) for q in range(p, 5)]
    sums = placed.groupBy("j").agg(F.count("y").alias("n"), *(F.sum(parts[p] * parts[q]).alias(f"m{p}{q}") for p, q in pairs)).collect()
    second, penalty = _spline_maps(at)
    k, n = len(at), sum(r["n"] for r in sums)
    gram, cross, square = np.zeros((k, k)), np.zeros(k), 0.0
    for r in sums:
        own = np.zeros((5, 5))
        for p, q in pairs:
            own[p, q] = own[q, p] = r[f"m{p}{q}"]
        local = _local(at, second, r["j"])
        gram += local.T @ own[:4, :4] @ local
        cross += local.T @ own[:4, 4]
        square += own[4, 4]
    return {"knots": at, "n": n} | _least_gcv(gram, cross, square, n, penalty, middle)


def _least_gcv(gram: np.ndarray, cross: np.ndarray, square: float, n: int, penalty: np.ndarray, middle: float) -> dict:
    """The penalty with the least score, on a grid over its logarithm and then by golden section."""
    # in coordinates where the cross products are one and the penalty is diagonal
    root = np.linalg.cholesky(gram + 1e-12 * np.trace(gram) / len(gram) * np.eye(len(gram)))
    half = np.linalg.solve(root, np.linalg.solve(root, penalty).T)
    weights, turn = np.linalg.eigh((half + half.T) / 2)
    weights = np.maximum(weights, 0)
    along = turn.T @ np.linalg.solve(root, cross)

    def score(power: float) -> tuple[float, float]:
        kept = 1 / (1 + np.exp(power) * weights)
        rss = square - 2 * (kept * along**2).sum() + (kept**2 * along**2).sum()
        edf = kept.sum()
        return (n * max(rss, 0.0) / (n - edf) ** 2 if n > edf + 1e-9 else np.inf), edf

    scale = np.log(1 / weights[weights > 1e-12 * weights.max()])
    grid = np.linspace(scale.min() - 12, scale.max() + 12, 201)
    best = int(np.argmin([score(g)[0] for g in grid]))
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, 200)]
    golden = (5**0.5 - 1) / 2
    for _ in range(100):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if score(a)[0] <= score(b)[0] else (a, high)
    power = (low + high) / 2
    gcv, edf = score(power)
    values = np.linalg.solve(root.T, turn @ (along / (1 + np.exp(power) * weights)))
    return {"values": values + middle, "penalty": float(np.exp(power)), "edf": float(edf), "gcv": float(gcv)}


def spline_curve(df: DataFrame, x: str = "predicted", y: str = "error", knots: int = 10, points: int = 80) -> DataFrame:
    """``(x, fit, edf)``: :func:`fit_spline` at ``points`` equal steps over the range of ``x``.

    NULLs are left out. One distinct x is one point; no row gives none.
    """
    schema = f"{x} double, fit double, edf double"
    found = fit_spline(df, x, y, knots)
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    at, values = found["knots"], found["values"]
    grid = np.unique(np.linspace(at[0], at[-1], points))
    if len(at) < 3:
        curve = np.interp(grid, at, values)
    else:
        second, _ = _spline_maps(at)
        j = np.clip(np.searchsorted(at, grid, side="right") - 1, 0, len(at) - 2)
        parts = np.stack(_functions(grid, at[j], at[j + 1]))
        slopes = second @ values
        curve = (parts * np.stack([values[j], values[j + 1], slopes[j], slopes[j + 1]])).sum(axis=0)
    rows = [(float(g), float(c), found["edf"]) for g, c in zip(grid, curve)]
    return df.sparkSession.createDataFrame(rows, schema)
