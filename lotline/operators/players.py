"""Which player took part in which auction, as seller or bidder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.schema import BIDDER, SELLER


def participations(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """One row per auction, player and type. Bids are reduced to distinct bidders before the join."""
    cols = ["player", "auction_uid", "end_ts", "tag", "type"]
    sellers = auctions.where("seller is not null").select(F.col("seller").alias("player"), "auction_uid", "end_ts", "tag", F.lit(SELLER).alias("type"))
    bidders = bids.where("bidder is not null").select(F.col("bidder").alias("player"), "auction_uid").distinct()
    bidders = bidders.join(auctions.select("auction_uid", "end_ts", "tag"), "auction_uid").withColumn("type", F.lit(BIDDER))
    return sellers.select(cols).unionByName(bidders.select(cols))


def auctions_of(participation: DataFrame, auctions: DataFrame, player: int, year: int, limit: int) -> DataFrame:
    """The auctions of a player's ``limit`` latest participations in a year."""
    mine = participation.where((F.col("player") == player) & (F.year("end_ts") == year))
    mine = mine.orderBy(F.col("end_ts").desc(), "auction_uid", "type").limit(limit)
    return auctions.join(mine.select("auction_uid").distinct(), "auction_uid", "left_semi")


def history(hot: DataFrame, cold: DataFrame, player: int, cutoff: str, limit: int) -> DataFrame:
    """A player's participations, recent ones from ``hot``, those up to ``cutoff`` from ``cold``, newest
    first."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    rows = hot.where(F.col("end_ts") > at).withColumn("archived", F.lit(False)).unionByName(cold.where(F.col("end_ts") <= at).withColumn("archived", F.lit(True)))
    return rows.where(F.col("player") == player).orderBy(F.col("end_ts").desc(), "auction_uid", "type").limit(limit)


def top_bidders(bids: DataFrame) -> DataFrame:
    """Per auction the bidder of the largest amount; of equal ones the least seq, then bidder."""
    return bids.groupBy("auction_uid").agg(F.max(F.struct("amount", (-F.col("seq")).alias("s"), (-F.col("bidder")).alias("b"))).alias("m")).select("auction_uid", F.col("m.amount").alias("amount"), (-F.col("m.b")).alias("bidder"))


def last_bids(bids: DataFrame) -> DataFrame:
    """Bids by one bidder at one instant replace one another: the largest stays."""
    w = Window.partitionBy("bidder", "ts").orderBy(F.col("amount").desc(), F.col("auction_uid").desc(), F.col("seq").desc())
    return bids.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
