"""Reading the input tables and cutting lineage with written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seepage.sources.checkpoint import fresh_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back.

    Every later step starts from the files, so a lost executor costs one step.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
