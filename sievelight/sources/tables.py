"""Tables of a folder, spread over the cluster where a file's row groups are too few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Deal rows anew if a scan has fewer partitions than there are cores.

    A small file with one row group would keep all work in one task. Larger
    tables have more splits than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = True) -> DataFrame:
    """A Parquet table; ``heavy`` says that its rows cost enough work to be worth spreading."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if heavy else df
