"""Train and test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfade.functions.exprs import split_label
from crossfade.operators.filters import require
from crossfade.operators.joins import anti_holdout, semi_holdout


def _share(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 100) that depends on the key only.

    A recomputed task gives the row the same label, and so does any other
    engine: the first 32 bits of an MD5 digest.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    bits = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return bits * F.lit(100.0) / F.lit(float(1 << 32))


def time_split(
    df: DataFrame, rel: str = "rel_time", train_before: int = -2, validation_to: int = 0
) -> DataFrame:
    return df.withColumn("data_split", split_label(rel, train_before, validation_to))


def random_split(
    df: DataFrame,
    key: Sequence[str],
    weights: Sequence[tuple[str, float]] = (("train", 70), ("validation", 15), ("test", 15)),
    seed: int = 42,
) -> DataFrame:
    """Labels by a hash of the key, in the given percentages."""
    require(df, *key)
    share, upper, label = _share(key, seed), 0.0, None
    for name, weight in weights[:-1]:
        upper += weight
        label = (F if label is None else label).when(share < upper, name)
    return df.withColumn("data_split", label.otherwise(weights[-1][0]))


def holdout_entities(
    df: DataFrame, entity: str = "gsis_id", percent: float = 20.0, seed: int = 42
) -> DataFrame:
    """About ``percent`` of the distinct entities, one row each."""
    return df.filter(_share([entity], seed) < percent).select(entity).distinct()


def entity_holdout_split(
    df: DataFrame,
    entity: str = "gsis_id",
    percent: float = 20.0,
    seed: int = 42,
) -> DataFrame:
    """Label all rows of an entity alike.

    Membership is a function of the entity, so labelling needs no join; it
    agrees with ``holdout_entities``.
    """
    held = F.coalesce(_share([entity], seed) < percent, F.lit(False))
    return df.withColumn("data_split", F.when(held, "test").otherwise("train"))


def split_by_entities(
    df: DataFrame, held_out: DataFrame, entity: str = "gsis_id"
) -> tuple[DataFrame, DataFrame]:
    """(train, test) for an explicit table of held-out entities."""
    return anti_holdout(df, held_out, entity), semi_holdout(df, held_out, entity)
