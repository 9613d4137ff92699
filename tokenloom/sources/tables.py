"""Reading the Parquet tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession

TOKENS = ("input_tokens", "output_tokens", "cache_read", "cache_write_5m", "cache_write_1h")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
