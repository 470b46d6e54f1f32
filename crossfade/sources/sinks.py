"""Table writers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def sink_parquet(
    df: DataFrame, path: str, partition_by: Iterable[str] | None = None
) -> None:
    """Write Parquet, optionally one folder per value of the partition columns."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def sink_csv(df: DataFrame, path: str, null_value: str = "NA") -> None:
    """Write CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True, nullValue=null_value)


def sink_by_split(df: DataFrame, path: str, split: str = "data_split") -> None:
    """One folder per split value in a single pass over the rows."""
    sink_parquet(df, path, [split])


def roundtrip(df: DataFrame, path: str) -> DataFrame:
    """Save a stage output and read it back."""
    sink_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
