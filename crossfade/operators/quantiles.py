"""Exact and approximate quantiles.

Spark's ``percentile`` keeps every distinct value of a group in one hash map,
which a large column doesn't fit. Here equal values are counted first, the
counts are sorted by range, so that a large group is spread over many tasks,
and each task adds the counts of the tasks before it. The rows that hold the
wanted ranks are all that is left. One plan serves every size, and the numbers
are those of ``percentile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfade.sources.staging import stage


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    exact: bool = True,
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group; each column becomes the array of its quantiles.

    Linear interpolation between order statistics, NULLs left out; a column
    without a value in a group has a NULL there. With ``exact=False`` the
    mergeable sketch of ``percentile_approx`` is used, without a stage table.
    """
    if not exact:
        sketches = [
            F.percentile_approx(F.col(c).cast("double"), list(map(float, probs)), accuracy).alias(c)
            for c in columns
        ]
        return df.groupBy(*by).agg(*sketches)
    keys = [*by, "_column"]
    pairs = [
        F.struct(F.lit(i).alias("_column"), F.col(c).cast("double").alias("_value"))
        for i, c in enumerate(columns)
    ]
    counted = df.select(*by, F.inline(F.array(*pairs))).groupBy(*keys, "_value")
    counted = counted.agg(F.count(F.lit(1)).alias("_rows"))
    # the id of a row holds its task above bit 33
    ordered = counted.orderBy(*keys, "_value").withColumn(
        "_task", F.shiftright(F.monotonically_increasing_id(), 33)
    )
    ordered = stage(ordered, "values")
    values = ordered.filter(F.col("_value").isNotNull())
    sums = values.groupBy(*keys, "_task").agg(F.sum("_rows").alias("_sum"))
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *keys, "_task",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_sum").over(of_key).alias("_n"),
    )
    in_task = Window.partitionBy(*keys, "_task").orderBy("_value")
    upto = F.sum("_rows").over(in_task.rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_task"]]
    placed = values.withColumn("_upto", upto).alias("v").join(starts.alias("s"), same)
    placed = placed.select("v.*", "s._n", (F.col("_before") + F.col("_upto")).alias("_end"))
    targets = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            targets.append(
                F.struct(
                    F.lit(i).alias("prob"), F.lit(side).alias("side"),
                    place.alias("place"), rank.alias("rank"),
                )
            )
    held = F.filter(
        F.array(*targets),
        lambda t: (t["rank"] < F.col("_end")) & (t["rank"] >= F.col("_end") - F.col("_rows")),
    )
    found = placed.select(*keys, "_value", F.inline(held)).groupBy(*keys, "prob").agg(
        F.max(F.when(F.col("side") == "low", F.col("_value"))).alias("low"),
        F.max(F.when(F.col("side") == "high", F.col("_value"))).alias("high"),
        F.max("place").alias("place"),
    )
    between = (F.ceil("place") - F.col("place")) * F.col("low") + (
        F.col("place") - F.floor("place")
    ) * F.col("high")
    quantile = F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(between)
    found = found.select(*keys, "prob", quantile.alias("q"))
    # groups without any value have a row as well
    groups = ordered.filter(F.col("_value").isNull()).select(*keys).distinct()
    found = found.unionByName(groups.withColumns({"prob": F.lit(-1), "q": F.lit(None).cast("double")}))
    one = lambda c, i: (F.col("_column") == c) & (F.col("prob") == i)
    picks = [
        F.when(
            F.count(F.when(one(c, 0), 1)) > 0,
            F.array(*[F.max(F.when(one(c, i), F.col("q"))) for i in range(len(probs))]),
        ).alias(name)
        for c, name in enumerate(columns)
    ]
    return found.groupBy(*by).agg(*picks)


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), **options) -> DataFrame:
    """Median per group and column."""
    halves = quantiles(df, columns, [0.5], by, **options)
    return halves.select(*by, *[F.col(c)[0].alias(c) for c in columns])
