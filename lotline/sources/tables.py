"""Auctions, bids and participations as views over the test tables.

Orders are auctions, lines bids, customers sellers; dates are moved by 24 years so that the first day
is that of the time keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.functions import timekey


def later(c: str) -> Column:
    """The date or time ``c``, 24 years on."""
    return F.col(c) + F.expr("INTERVAL '24' YEAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("auction_uid"), F.col("l_suppkey").alias("bidder"), F.round("l_extendedprice").cast("long").alias("amount"),
        F.col("l_linenumber").alias("seq"), later("l_shipdate").alias("ts"),
    )


def unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auctions without what follows from their bids."""
    key, day = F.col("o_orderkey"), later("o_orderdate")
    tag = F.when(F.col("o_orderpriority") == "1-URGENT", "ENCHANTED_BOOK").when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        key.alias("auction_uid"), F.md5(key.cast("string")).alias("uuid"), tag.alias("tag"), F.col("o_custkey").alias("seller"),
        F.timestamp_add("SECOND", ((key * 7919) % 86400).cast("int"), day).alias("end_ts"), (day - F.make_dt_interval((key % 14 + 1).cast("int"))).alias("start_ts"),
        (key % 2 == 0).alias("bin"), F.col("o_orderstatus").alias("tier"),
    )


def priced(rows: DataFrame, all_bids: DataFrame) -> DataFrame:
    """``rows`` of unpriced() with highest_bid, bid_count and is_sold."""
    top = all_bids.groupBy("auction_uid").agg(F.max("amount").alias("_high"), F.count("*").alias("_n"))
    high = F.coalesce("_high", F.lit(0).cast("long"))
    out = rows.join(top, "auction_uid", "left")
    return out.select("*", high.alias("highest_bid"), F.coalesce("_n", F.lit(0).cast("long")).alias("bid_count"), (high > 0).alias("is_sold")).drop("_high", "_n")


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(unpriced(spark, sf_dir), bids(spark, sf_dir))


def few_priced(rows: DataFrame, all_bids: DataFrame) -> DataFrame:
    """priced(), of ``rows`` that are few by a limit: other bids are left out before they are summed."""
    return priced(rows, all_bids.join(F.broadcast(rows.select("auction_uid")), "auction_uid", "left_semi"))


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time_key", timekey.time_key(F.col("tag"), F.col("end_ts")))


def with_bids(rows: DataFrame, all_bids: DataFrame) -> DataFrame:
    """``rows`` with an array of their bids, ordered by amount, bidder, seq."""
    item = F.struct("amount", "bidder", "seq", "ts")
    lists = all_bids.groupBy("auction_uid").agg(F.array_sort(F.collect_list(item)).alias("bids"))
    empty = F.array().cast("array<struct<amount:bigint,bidder:bigint,seq:int,ts:timestamp_ntz>>")
    return rows.join(lists, "auction_uid", "left").withColumn("bids", F.coalesce("bids", empty))
