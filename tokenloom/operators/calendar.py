"""Dense calendars, streaks and windows that end at an explicit day.

A daily roll-up has one row a day, so windows over all of them are small at any size of input.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def days(spark: SparkSession, as_of: str, n: int) -> DataFrame:
    end = F.lit(as_of).cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(end, n - 1), end)).alias("date"))


def dense(spark: SparkSession, daily: DataFrame, as_of: str, n: int, defaults: dict[str, float]) -> DataFrame:
    """The last n days of a daily roll-up (`date` and measures), idle days filled with defaults."""
    return days(spark, as_of, n).join(daily, "date", "left").fillna(defaults)


def streak(daily: DataFrame, as_of: str) -> DataFrame:
    """streak: how many consecutive active days end at `as_of`, or the day before if it is idle."""
    end = F.lit(as_of).cast("date")
    active = daily.where((F.col("total") > 0) & (F.col("date") <= end)).select("date")
    islands = active.withColumn("island", F.date_sub("date", F.row_number().over(Window.orderBy("date"))))
    runs = islands.groupBy("island").agg(F.max("date").alias("last"), F.count("*").alias("n"))
    return runs.agg(F.coalesce(F.max(F.when(F.col("last") >= F.date_sub(end, 1), F.col("n"))), F.lit(0)).alias("streak"))


def month_to_date(daily: DataFrame, as_of: str) -> DataFrame:
    end = F.lit(as_of).cast("date")
    return daily.where((F.trunc("date", "MM") == F.trunc(end, "MM")) & (F.col("date") <= end))
