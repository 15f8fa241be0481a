"""Reading the Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.session import ship


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
