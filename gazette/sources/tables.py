"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as it is stored."""
    return spark.read.parquet(path)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A table for work that costs much more per row than moving the row does.

    A table stored in fewer splits than there are cores is dealt out to all of them; a
    table with enough splits, as any large one has, is left where it is.
    """
    table = read_table(spark, path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def read_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not have been written yet: empty until it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
