"""Stage tables: results that several later plans read.

A stage is a Parquet table in the shared folder named by
``spark.checkpoint.dir``. Compared with ``cache()`` it survives the loss of
executors, and compared with ``checkpoint()`` it keeps column pruning, filter
pushdown and a known size for the plans that read it.

The known size also decides joins. A group statistic that is staged before it
is joined back is broadcast when its files are below
``spark.sql.autoBroadcastJoinThreshold`` and sort-merge joined when they are
not; the large side is then neither shuffled for nothing nor held up by a few
hot keys, and nothing is broadcast on trust.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stager = Callable[[DataFrame, str], DataFrame]


def unstaged(df: DataFrame, name: str = "table") -> DataFrame:
    """Leave ``df`` lazy: the default where staging is a choice."""
    return df


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Where ``spark.checkpoint.dir`` is unset it is a folder of the warehouse,
    which executors share as well.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return the reader of the written table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
