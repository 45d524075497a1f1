"""A price history that is computed once a day and tag, and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.operators import prices

MEMO = "tag string, max bigint, min bigint, mean double, med bigint, mode bigint, volume double, day timestamp_ntz"


class PriceMemo:
    """Daily summaries of one set of filters in ``path``. Missing days are found by an anti-join with
    the wanted days and added by one job, whatever their number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], MEMO).write.mode("append").parquet(path)

    def stored(self) -> DataFrame:
        return self.spark.read.schema(MEMO).parquet(self.path)

    def missing(self, tags: DataFrame, first: str, last: str) -> DataFrame:
        return prices.days(tags, first, last).join(self.stored().select("tag", "day"), ["tag", "day"], "left_anti")

    def history(self, sold: DataFrame, first: str, last: str) -> DataFrame:
        new = self.missing(sold, first, last)
        start = F.lit(first).cast("timestamp_ntz") - prices.day()
        rows = sold.where((F.col("end_ts") > start) & (F.col("end_ts") <= F.lit(last).cast("timestamp_ntz"))).withColumn("day", prices.closing_day(F.col("end_ts")))
        found = prices.summary(rows.join(new, ["tag", "day"], "left_semi"), ["tag", "day"])
        new.join(found, ["tag", "day"], "left").fillna(0).select(*[c.split(" ")[0] for c in MEMO.split(", ")]).write.mode("append").parquet(self.path)
        return self.stored().where(F.col("day").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
