"""Tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, dealt out anew only if its files give fewer partitions than there are cores.

    Small tables lie in one file with one row group, which a single task would read and work
    on alone; a table of many files is read as it lies, without a shuffle.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
