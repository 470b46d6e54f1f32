"""Connected components of a link table, by alternating large and small stars.

Each round is two grouped minima and two equality joins; a vertex with very
many links is pre-aggregated before its shuffle and split as a skewed join.
Rounds are written to the shared folder, so no lineage grows and no executor's
loss costs more than the round at hand. Nothing but two numbers per round
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfade.sources.staging import stage


def _signature(links: DataFrame) -> tuple[int, int | None]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the vertex's least one."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.filter(F.col("v") > F.col("u"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and itself, is linked to the least one."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").filter(F.col("v") != F.col("m"))
    return (
        others.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(vertex, root)`` for every vertex of ``links``; the root is the least vertex reachable.

    Links are undirected; repeated links, loops and NULL ends change nothing (a
    vertex with only a loop has no row). Vertices are whole numbers.
    """
    oriented = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("p"), F.col(b).alias("q"))
    oriented = oriented.filter(F.col("p") != F.col("q")).select("u", "v").distinct()
    now = stage(oriented, "links")
    mark = _signature(now)
    while mark[0]:
        following = stage(_small_star(_large_star(now)), "stars")
        before, mark, now = mark, _signature(following), following
        if mark == before:
            break
    roots = now.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("root"))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
