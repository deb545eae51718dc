"""Readers of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.session import parallelism


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One stored table, with only ``columns`` where some are named (the scan then reads no others)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A plain scan over all task slots, for work that is heavy per row: a table of one small file would else be one task.

    Large tables have enough splits of their own and are left as they are, so nothing is shuffled there.
    """
    slots = parallelism(df.sparkSession)
    return df.repartition(slots) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 < slots else df
