"""Price statistics of sold auctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day() -> Column:
    """An interval of one day."""
    return F.expr("INTERVAL '1' DAY")


def summary(sold: DataFrame, by: list[str], price: str = "highest_bid") -> DataFrame:
    """Per ``by``: min, max, mean, upper median, mode and volume of ``price``.

    Prices are counted per value before anything is ordered, so a hot group is reduced map-side and
    its window runs over distinct prices. Of equally frequent prices the one seen last wins, then the
    smaller.
    """
    counts = sold.groupBy(*by, F.col(price).alias("p")).agg(F.count("*").alias("n"), F.max("end_ts").alias("seen"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    half = F.call_function("div", F.col("total"), F.lit(2))
    return ranked.groupBy(*by).agg(
        F.max("p").alias("max"), F.min("p").alias("min"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min(F.when(F.col("upto") > half, F.col("p"))).alias("med"), F.max(F.struct("n", "seen", (-F.col("p")).alias("q"))).alias("_m"), F.sum("n").cast("double").alias("volume"),
    ).select(*by, "max", "min", "mean", "med", (-F.col("_m.q")).alias("mode"), "volume")


def in_window(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Sold auctions that ended after ``start`` and before ``end``."""
    return rows.where(F.col("is_sold") & (F.col("end_ts") > F.lit(start).cast("timestamp_ntz")) & (F.col("end_ts") < F.lit(end).cast("timestamp_ntz")))


def closing_day(end: Column) -> Column:
    """The midnight that closes the day (day - 1, day] of ``end``."""
    return F.date_trunc("day", end - F.expr("INTERVAL '0.000001' SECOND")).cast("timestamp_ntz") + day()


def days(tags: DataFrame, first: str, last: str) -> DataFrame:
    """Every day from ``first`` to ``last`` of every tag."""
    span = F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"), day())
    return tags.select("tag").distinct().withColumn("day", F.explode(span))


def daily(sold: DataFrame) -> DataFrame:
    return summary(sold.withColumn("day", closing_day(F.col("end_ts"))), ["tag", "day"])


def history(sold: DataFrame, first: str, last: str) -> DataFrame:
    """daily() for all days of all tags of ``sold``, zeros where nothing was sold."""
    start = F.lit(first).cast("timestamp_ntz") - day()
    wanted = sold.where((F.col("end_ts") > start) & (F.col("end_ts") <= F.lit(last).cast("timestamp_ntz")))
    return days(sold, first, last).join(daily(wanted), ["tag", "day"], "left").fillna(0)


def hourly(rows: DataFrame) -> DataFrame:
    """By tag and hour of day: mean, min, max, number, and the first end."""
    return rows.groupBy("tag", F.hour("end_ts").alias("hour")).agg(
        F.avg("highest_bid").alias("mean"), F.min("highest_bid").alias("min"), F.max("highest_bid").alias("max"), F.count("*").alias("volume"), F.min("end_ts").alias("first_end")
    )
