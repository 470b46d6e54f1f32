"""Linear mixed models by REML from grouped statistics.

Model: y = X b + Z u + e per entity, with an intercept and, if asked for, a
slope in relative time as the random part, and residual variances that may
differ between two phases.

The likelihood needs the rows only through sums of products per entity. Those
are reduced once more: entities with equal Z'Z ("pattern") contribute to every
evaluation with the same small matrix, so the sums over them of products of
their statistics are enough. The number of patterns depends on how many rows
an entity has at which relative times, not on the number of entities, so an
evaluation costs the same for a thousand entities and for a billion. Two
aggregations build the pattern table; the optimiser on the driver then reads a
table of bounded, checked size. Beyond the bound each evaluation is a
distributed sum over the pattern table instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfade.operators.quantiles import quantiles
from crossfade.sources.staging import stage

PATTERN_LIMIT = 20_000


@dataclass
class MixedModel:
    """A fitted model; ``entities`` holds the statistics of each entity."""

    names: list[str]
    beta: np.ndarray
    cov_beta: np.ndarray
    sigma2: float
    factor: np.ndarray  # Cholesky factor of the random covariance over sigma2
    weights: np.ndarray  # residual variance per phase over the first one's
    deviance: float
    n_rows: int
    n_entities: int
    y: str
    fixed: dict[str, Column]
    entity: str
    slope: str | None
    phase: str | None
    entities: DataFrame = field(repr=False)
    scaled_beta: np.ndarray  # of the centred and scaled values that ``entities`` sums
    unit: float  # of y in these
    evaluations: int = 0
    converged: bool = True

    @property
    def covariance(self) -> np.ndarray:
        """Covariance of the random effects."""
        return self.sigma2 * self.factor @ self.factor.T

    @property
    def aic(self) -> float:
        q = self.factor.shape[0]
        free = len(self.names) + q * (q + 1) // 2 + len(self.weights)
        return self.deviance + 2 * free


# -- statistics ------------------------------------------------------------


def _design(
    df: DataFrame,
    y: str,
    fixed: dict[str, Column],
    entity: str,
    slope: str | None,
    phase: str | None,
) -> DataFrame:
    """Complete rows only: entity, phase number, y, x0.., z."""
    columns = {"x0": F.lit(1.0)}
    columns.update({f"x{i}": c.cast("double") for i, c in enumerate(fixed.values(), 1)})
    selected = df.select(
        F.col(entity).alias("e"),
        (F.col(phase).cast("int") if phase else F.lit(0)).alias("ph"),
        F.col(y).cast("double").alias("y"),
        *[c.alias(n) for n, c in columns.items()],
        *([F.col(slope).cast("double").alias("z")] if slope else []),
    )
    return selected.dropna()


def _centres(rows: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of x1.. and y, in this order; a constant has deviation 1."""
    names = [f"x{k}" for k in range(1, p)] + ["y"]
    out = [f"avg({n}) AS m{i}" for i, n in enumerate(names)]
    out += [f"stddev_pop({n}) AS s{i}" for i, n in enumerate(names)]
    row = rows.agg(*map(F.expr, out)).first()
    if row["m0"] is None:
        raise ValueError("no complete rows to fit")
    mean = np.array([row[f"m{i}"] for i in range(p)])
    deviation = np.array([row[f"s{i}"] for i in range(p)])
    # what is left of a constant after rounding is no spread
    flat = ~(deviation > 1e-12 * np.abs(mean))
    return mean, np.where(flat, 1.0, deviation)


def _centred(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    """x1.. and y around their means, in units of their deviations.

    Sums of products of large values would otherwise lose what they differ by.
    """
    names = [f"x{k}" for k in range(1, len(mean))] + ["y"]
    return rows.withColumns(
        {
            n: (F.col(n) - F.lit(float(m))) / F.lit(float(d))
            for n, m, d in zip(names, mean, deviation)
        }
    )


def _entity_statistics(
    rows: DataFrame, p: int, slope: bool, phases: int
) -> DataFrame:
    """Per entity and phase block: Z'Z, Z'X and Z'y as plain sums.

    SQL text, here and below: hundreds of sums are much quicker to parse than
    to build call by call.
    """
    values = [f"x{k}" for k in range(p)] + ["y"]
    basis = ["1D", "z"] if slope else ["1D"]
    out = []
    for g in range(phases):
        inside = f"if(ph = {g}, 1D, 0D)" if phases > 1 else "1D"
        for a, za in enumerate(basis):
            for b in range(a, len(basis)):
                out.append(f"sum({inside} * {za} * {basis[b]}) AS zz_{g}_{a}{b}")
            for k, v in enumerate(values):
                out.append(f"sum({inside} * {za} * {v}) AS u_{g}_{a}_{k}")
    return rows.groupBy("e").agg(*map(F.expr, out))


def _total_products(rows: DataFrame, p: int, phases: int) -> list[np.ndarray]:
    """Per phase the matrix of sums of products of (X, y), and the row count."""
    values = [f"x{k}" for k in range(p)] + ["y"]
    pairs = list(combinations_with_replacement(range(p + 1), 2))
    collected = (
        rows.groupBy("ph")
        .agg(*[F.expr(f"sum({values[i]} * {values[j]}) AS t_{i}_{j}") for i, j in pairs])
        .collect()
    )
    totals = [np.zeros((p + 1, p + 1)) for _ in range(phases)]
    for r in collected:
        for i, j in pairs:
            totals[r["ph"]][i, j] = totals[r["ph"]][j, i] = r[f"t_{i}_{j}"]
    return totals


def _pattern_table(entities: DataFrame, p: int, q: int, phases: int) -> DataFrame:
    """Sums of products of the entity statistics, by equal Z'Z."""
    keys = [f"zz_{g}_{a}{b}" for g in range(phases) for a in range(q) for b in range(a, q)]
    stats = [f"u_{g}_{a}_{k}" for g in range(phases) for a in range(q) for k in range(p + 1)]
    products = [
        F.expr(f"sum({stats[i]} * {stats[j]}) AS c_{i}_{j}")
        for i, j in combinations_with_replacement(range(len(stats)), 2)
    ]
    return entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *products)


class _Evaluator:
    """Deviance terms of pattern rows for given variance parameters."""

    def __init__(self, p: int, q: int, phases: int):
        self.p, self.q, self.phases = p, q, phases
        self.size = phases * q * (p + 1)
        self.pairs = list(combinations_with_replacement(range(self.size), 2))

    def load(self, table: pd.DataFrame):
        n, q, phases = len(table), self.q, self.phases
        zz = np.zeros((n, phases, q, q))
        for g in range(phases):
            for a in range(q):
                for b in range(a, q):
                    zz[:, g, a, b] = zz[:, g, b, a] = table[f"zz_{g}_{a}{b}"]
        cross = np.zeros((n, self.size, self.size))
        for i, j in self.pairs:
            cross[:, i, j] = cross[:, j, i] = table[f"c_{i}_{j}"]
        shape = (n, phases, q, self.p + 1, phases, q, self.p + 1)
        return table["m"].to_numpy(float), zz, cross.reshape(shape)

    def terms(self, loaded, factor: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """[log det, matrix to subtract from the products of (X, y)], flattened."""
        m, zz, cross = loaded
        inverse = 1.0 / weights
        weighted = np.einsum("ngab,g->nab", zz, inverse)
        inner = np.eye(self.q) + factor.T @ weighted @ factor
        logdet = float((m * np.linalg.slogdet(inner)[1]).sum())
        middle = factor @ np.linalg.inv(inner) @ factor.T
        summed = np.einsum("ngakhbl,g,h->nabkl", cross, inverse, inverse)
        removed = np.einsum("nab,nabkl->kl", middle, summed)
        return np.concatenate([[logdet], removed.ravel()])


def _distributed(table: DataFrame, evaluator: _Evaluator):
    """An evaluation as a sum over the pattern table's tasks."""
    width = 1 + (evaluator.p + 1) ** 2

    def evaluate(factor: np.ndarray, weights: np.ndarray) -> np.ndarray:
        def part(frames):
            total = np.zeros(width)
            for frame in frames:
                total += evaluator.terms(evaluator.load(frame), factor, weights)
            yield pd.DataFrame({"i": range(width), "v": total})

        sums = table.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v"))
        out = np.zeros(width)
        for i, v in sums.collect():
            out[i] = v
        return out

    return evaluate


# -- optimisation ----------------------------------------------------------


def nelder_mead(
    f: Callable[[np.ndarray], float],
    start: np.ndarray,
    step: float = 0.4,
    tol: float = 1e-10,
    limit: int = 4000,
) -> tuple[np.ndarray, float, bool]:
    """Minimum of a function of few variables without derivatives.

    The third result says whether it settled within ``limit`` rounds.
    """
    n, settled = len(start), False
    points = [np.array(start, float)]
    for i in range(n):
        shifted = np.array(start, float)
        shifted[i] += step
        points.append(shifted)
    values = [f(x) for x in points]
    for _ in range(limit):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        spread = max(np.abs(x - points[0]).max() for x in points[1:])
        if values[-1] - values[0] <= tol * (abs(values[0]) + tol) and spread < 1e-6:
            settled = True
            break
        centre = np.mean(points[:-1], axis=0)
        reflected = centre + (centre - points[-1])
        fr = f(reflected)
        if fr < values[0]:
            expanded = centre + 2 * (centre - points[-1])
            fe = f(expanded)
            points[-1], values[-1] = (expanded, fe) if fe < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            towards = reflected if fr < values[-1] else points[-1]
            inner = centre + 0.5 * (towards - centre)
            fi = f(inner)
            if fi < min(fr, values[-1]):
                points[-1], values[-1] = inner, fi
            else:
                best = points[0]
                points = [best] + [best + 0.5 * (x - best) for x in points[1:]]
                values = [values[0]] + [f(x) for x in points[1:]]
    best = int(np.argmin(values))
    return points[best], values[best], settled


def _unpack(theta: np.ndarray, q: int, phases: int) -> tuple[np.ndarray, np.ndarray]:
    """Variance parameters: lower triangle of the factor, log weight ratios."""
    factor = np.zeros((q, q))
    factor[np.tril_indices(q)] = theta[: q * (q + 1) // 2]
    weights = np.exp(np.concatenate([[0.0], theta[q * (q + 1) // 2 :]]))
    return factor, weights[:phases]


def fit_lmm(
    df: DataFrame,
    y: str,
    fixed: dict[str, Column],
    entity: str = "gsis_id",
    slope: str | None = None,
    phase: str | None = None,
    pattern_limit: int = PATTERN_LIMIT,
) -> MixedModel:
    """REML fit of y on the named fixed terms (an intercept is added).

    ``slope`` adds a random slope in that column to the random intercept;
    ``phase`` (0/1) gives each phase its own residual variance. The fit works
    on centred and scaled values, so it does not depend on the units or the
    origin of y and the fixed terms; a fit that doesn't converge is an error.
    """
    p, q, phases = len(fixed) + 1, 2 if slope else 1, 2 if phase else 1
    rows = _design(df, y, fixed, entity, slope, phase)
    mean, deviation = _centres(rows, p)
    rows = _centred(rows, mean, deviation)
    totals = _total_products(rows, p, phases)
    entities = stage(_entity_statistics(rows, p, bool(slope), phases), "entities")
    table = _pattern_table(entities, p, q, phases)
    evaluator = _Evaluator(p, q, phases)
    head = table.limit(pattern_limit + 1).toPandas()
    if len(head) <= pattern_limit:
        loaded = evaluator.load(head)
        evaluate = lambda factor, weights: evaluator.terms(loaded, factor, weights)
        n_entities = int(head["m"].sum())
    else:
        table = stage(table, "patterns")
        evaluate = _distributed(table, evaluator)
        n_entities = entities.count()
    per_phase = np.array([t[0, 0] for t in totals])
    n_rows = float(per_phase.sum())
    calls = 0

    def solve(theta: np.ndarray):
        nonlocal calls
        calls += 1
        factor, weights = _unpack(theta, q, phases)
        terms = evaluate(factor, weights)
        products = sum(t / w for t, w in zip(totals, weights)) - terms[1:].reshape(p + 1, p + 1)
        left, right = products[:p, :p], products[:p, p]
        sign, logdet_left = np.linalg.slogdet(left)
        if sign <= 0:
            return None
        beta = np.linalg.solve(left, right)
        rss = products[p, p] - right @ beta
        if rss <= 0:
            return None
        free = n_rows - p
        deviance = (
            terms[0]
            + float(per_phase @ np.log(weights))
            + logdet_left
            + free * (1 + math.log(2 * math.pi * rss / free))
        )
        return deviance, beta, left, rss / free

    def objective(theta: np.ndarray) -> float:
        solved = solve(theta)
        return math.inf if solved is None else solved[0]

    start = np.zeros(q * (q + 1) // 2 + phases - 1)
    start[0] = 0.5
    if q == 2:
        start[2] = 0.3
    theta, _, _ = nelder_mead(objective, start)
    theta, _, converged = nelder_mead(objective, theta, step=0.1)
    solved = solve(theta)
    if solved is None:
        raise ValueError("the fixed terms are linearly dependent")
    if not converged:
        raise ValueError("the variance parameters did not converge")
    deviance, scaled_beta, left, scaled_sigma2 = solved
    factor, weights = _unpack(theta, q, phases)
    # back to the units of the data: b = back b' + (mean of y)
    unit = float(deviation[-1])
    back = np.diag(np.append(1.0, 1.0 / deviation[:-1]))
    back[0, 1:] = -mean[:-1] / deviation[:-1]
    beta = unit * back @ scaled_beta
    beta[0] += mean[-1]
    sigma2 = unit * unit * scaled_sigma2
    deviance += (n_rows - p) * 2 * math.log(unit) + 2 * float(np.log(deviation[:-1]).sum())
    return MixedModel(
        names=["(Intercept)", *fixed],
        beta=beta,
        cov_beta=sigma2 * back @ np.linalg.inv(left) @ back.T,
        sigma2=float(sigma2),
        factor=factor,
        weights=weights,
        deviance=float(deviance),
        n_rows=int(n_rows),
        n_entities=n_entities,
        y=y,
        fixed=fixed,
        entity=entity,
        slope=slope,
        phase=phase,
        entities=entities,
        scaled_beta=scaled_beta,
        unit=unit,
        evaluations=calls,
        converged=converged,
    )


# -- results ---------------------------------------------------------------


def fixed_effect_table(model: MixedModel, spark: SparkSession) -> DataFrame:
    """Estimate, standard error, t value, and correlations with the terms."""
    se = np.sqrt(np.diag(model.cov_beta))
    correlation = model.cov_beta / np.outer(se, se)
    rows = [
        (name, float(b), float(s), float(b / s), [float(v) for v in row])
        for name, b, s, row in zip(model.names, model.beta, se, correlation)
    ]
    return spark.createDataFrame(
        rows,
        "term string, estimate double, std_error double, t_value double,"
        " correlation array<double>",
    )


def variance_table(model: MixedModel, spark: SparkSession) -> DataFrame:
    """Variance components, with the fit's size and REML criterion."""
    d = model.covariance
    rows = [("entity_intercept", float(d[0, 0]), None)]
    if model.slope:
        scale = math.sqrt(d[0, 0] * d[1, 1])
        rows.append(
            ("entity_slope", float(d[1, 1]), float(d[0, 1] / scale) if scale > 0 else None)
        )
    for g, w in enumerate(model.weights):
        label = "residual" if len(model.weights) == 1 else f"residual_phase_{g}"
        rows.append((label, float(model.sigma2 * w), None))
    rows.append(("reml_criterion", model.deviance, None))
    rows.append(("n_rows", float(model.n_rows), None))
    rows.append(("n_entities", float(model.n_entities), None))
    return spark.createDataFrame(rows, "component string, value double, correlation double")


def random_effects(model: MixedModel) -> DataFrame:
    """Predicted intercept and slope per entity, as column expressions.

    u = D V^-1 (y - X b) from the entity's own sums; the matrices are at most
    2 x 2, so the inverse is written out.
    """
    p = len(model.names)
    inverse = [float(1 / w) for w in model.weights]
    q = model.factor.shape[0]
    lam = model.factor @ model.factor.T

    def weighted(name: Callable[[int], str]) -> Column:
        return sum(
            (F.col(name(g)) * F.lit(w) for g, w in enumerate(inverse)), F.lit(0.0)
        )

    residual = []
    for a in range(q):
        value = weighted(lambda g, a=a: f"u_{g}_{a}_{p}")
        for k in range(p):
            value = value - weighted(lambda g, a=a, k=k: f"u_{g}_{a}_{k}") * F.lit(
                float(model.scaled_beta[k])
            )
        residual.append(value * F.lit(model.unit))
    zz = {
        (a, b): weighted(lambda g, a=a, b=b: f"zz_{g}_{a}{b}")
        for a in range(q)
        for b in range(a, q)
    }
    lit = lambda x: F.lit(float(x))
    if q == 1:
        intercept = lit(lam[0, 0]) * residual[0] / (F.lit(1.0) + zz[0, 0] * lit(lam[0, 0]))
        return model.entities.select(
            F.col("e").alias(model.entity), intercept.alias("intercept")
        )
    # (I + ZZ L) v = r, then u = L v
    a = F.lit(1.0) + zz[0, 0] * lit(lam[0, 0]) + zz[0, 1] * lit(lam[1, 0])
    b = zz[0, 0] * lit(lam[0, 1]) + zz[0, 1] * lit(lam[1, 1])
    c = zz[0, 1] * lit(lam[0, 0]) + zz[1, 1] * lit(lam[1, 0])
    d = F.lit(1.0) + zz[0, 1] * lit(lam[0, 1]) + zz[1, 1] * lit(lam[1, 1])
    det = a * d - b * c
    v0 = (d * residual[0] - b * residual[1]) / det
    v1 = (a * residual[1] - c * residual[0]) / det
    return model.entities.select(
        F.col("e").alias(model.entity),
        (lit(lam[0, 0]) * v0 + lit(lam[0, 1]) * v1).alias("intercept"),
        (lit(lam[1, 0]) * v0 + lit(lam[1, 1]) * v1).alias("slope"),
    )


def fitted_residuals(
    model: MixedModel, df: DataFrame, keys: Sequence[str] = ("gsis_id", "season")
) -> DataFrame:
    """Fitted value and residual of each complete row."""
    mean = F.lit(float(model.beta[0]))
    for b, c in zip(model.beta[1:], model.fixed.values()):
        mean = mean + F.lit(float(b)) * c.cast("double")
    needed = list(dict.fromkeys([*keys, model.entity]))
    rows = df.select(
        *needed,
        F.col(model.y).alias("actual"),
        mean.alias("_mean"),
        *([F.col(model.slope).alias("_z")] if model.slope else []),
    ).dropna()
    joined = rows.join(random_effects(model), model.entity, "left")
    effect = F.coalesce(F.col("intercept"), F.lit(0.0))
    if model.slope:
        effect = effect + F.coalesce(F.col("slope"), F.lit(0.0)) * F.col("_z")
    fitted = F.col("_mean") + effect
    return joined.select(
        *keys,
        "actual",
        fitted.alias("fitted"),
        (F.col("actual") - fitted).alias("residual"),
    )


def scaled_residuals(model: MixedModel, df: DataFrame) -> DataFrame:
    """Five numbers of the residuals over their standard deviation."""
    keys = [model.entity, *([model.phase] if model.phase else [])]
    rows = fitted_residuals(model, df, keys)
    weight = F.lit(float(model.weights[0]))
    for g, w in enumerate(model.weights[1:], 1):
        weight = F.when(F.col(model.phase).cast("int") == g, F.lit(float(w))).otherwise(weight)
    scaled = F.col("residual") / F.sqrt(F.lit(float(model.sigma2)) * weight)
    five = quantiles(rows.select(scaled.alias("q")), ["q"], [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ("minimum", "lower_quartile", "median", "upper_quartile", "maximum")
    return five.select(*[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def likelihood_ratio(
    larger: MixedModel, smaller: MixedModel, spark: SparkSession
) -> DataFrame:
    """Test of one more variance parameter, with equal fixed terms."""
    if larger.names != smaller.names:
        raise ValueError("REML criteria need the same fixed terms")
    ratio = max(0.0, smaller.deviance - larger.deviance)
    p_value = math.erfc(math.sqrt(ratio / 2))
    return spark.createDataFrame(
        [(-smaller.deviance / 2, -larger.deviance / 2, ratio, 1, p_value)],
        "loglik_equal double, loglik_phases double, ratio double, df int, p_value double",
    )


def marginal_effects(
    model: MixedModel,
    df: DataFrame,
    post: str,
    groups: Sequence[str],
    group_terms: dict[str, str],
    interaction_terms: dict[str, str],
    held: Mapping[str, float] | None = None,
) -> DataFrame:
    """Predicted metric by (post, group), other terms at their mean.

    ``group_terms`` and ``interaction_terms`` name the model's terms of each
    group but the first, which is the baseline. ``held`` gives the values of
    terms that are not to be at their own mean, such as powers of a variable
    that is at its mean.
    """
    varied = {post, *group_terms.values(), *interaction_terms.values()}
    held = dict(held or {})
    others = [n for n in model.names[1:] if n not in varied and n not in held]
    complete = F.lit(True)
    for c in [F.col(model.y), *model.fixed.values()]:
        complete = complete & c.isNotNull()
    means = df.filter(complete).agg(
        *[F.avg(model.fixed[n].cast("double")).alias(f"m{i}") for i, n in enumerate(others)]
    ).first() if others else ()
    at = {**dict(zip(others, means)), **held}
    rows = []
    for group in groups:
        for flag in (0, 1):
            x = np.zeros(len(model.names))
            x[0] = 1.0
            for i, n in enumerate(model.names[1:], 1):
                if n == post:
                    x[i] = flag
                elif n == group_terms.get(group):
                    x[i] = 1.0
                elif n == interaction_terms.get(group):
                    x[i] = flag
                elif n in at:
                    x[i] = at[n]
            value = float(x @ model.beta)
            se = float(math.sqrt(x @ model.cov_beta @ x))
            rows.append((group, flag, value, se, value - 1.96 * se, value + 1.96 * se))
    return df.sparkSession.createDataFrame(
        rows,
        "position_group string, post_transition int, predicted double,"
        " std_error double, conf_low double, conf_high double",
    )


def anova_icc(df: DataFrame, y: str = "z_score", entity: str = "gsis_id") -> DataFrame:
    """Between-entity share of variance from a one-way analysis of variance.

    Two nested aggregates: sums per entity, then sums over entities.
    """
    per = df.filter(F.col(y).isNotNull()).groupBy(entity).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var")
    )
    n, m = F.col("n"), F.col("mean")
    sums = per.agg(
        F.sum(n).alias("rows"),
        F.count(F.lit(1)).alias("k"),
        F.sum(n * n).alias("n2"),
        F.sum(n * m).alias("s1"),
        F.sum(n * m * m).alias("s2"),
        F.sum(n * F.col("var")).alias("within"),
    )
    rows, k = F.col("rows"), F.col("k")
    between = F.try_divide(F.col("s2") - F.try_divide(F.col("s1") * F.col("s1"), rows), k - 1)
    within = F.try_divide(F.col("within"), rows - k)
    size = F.try_divide(rows - F.try_divide(F.col("n2"), rows), k - 1)
    out = sums.select(
        k.alias("n_entities"), rows.alias("n_rows"), between.alias("ms_between"),
        within.alias("ms_within"), size.alias("n0"),
    )
    variance = F.greatest(
        F.try_divide(F.col("ms_between") - F.col("ms_within"), F.col("n0")), F.lit(0.0)
    )
    out = out.withColumn("var_entity", variance)
    return out.withColumn(
        "icc", F.try_divide(F.col("var_entity"), F.col("var_entity") + F.col("ms_within"))
    )
