"""Merging new rows into kept ones: upserts, archives, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import identity, timekey

#: What a sold auction that came without a start takes from its unsold record.
RETROFITTED = ("start_ts", "count", "item_created_at", "item_name", "profile", "bin", "starting_bid")


def best_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def upsert_changed(stored: DataFrame, incoming: DataFrame, key: list[str], watched: list[str]) -> DataFrame:
    """Rows of ``incoming`` to write: not junk, and new or changed in ``watched``."""
    old = stored.select(*key, *[F.col(c).alias(f"_old_{c}") for c in watched], F.lit(True).alias("_had"))
    same = F.col("_had").isNotNull()
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return incoming.join(old, key, "left").where(~same).select(*incoming.columns, F.when(F.col("_had").isNull(), "insert").otherwise("update").alias("action"))


def reimport(stored: DataFrame, source: DataFrame, id_: int, key: list[str], watched: list[str]) -> DataFrame:
    """The row of ``source`` with one auction_uid, if it is to be written: upsert_changed() of it alone. Both
    sides are filtered before they meet."""
    one = F.col("auction_uid") == id_
    return upsert_changed(stored.where(one), source.where(one), key, watched)


def last_write(rows: DataFrame, key: list[str], written: str = "write_ts") -> DataFrame:
    """Last write wins, by event time; of equal times the larger bid."""
    return best_per_key(rows, key, [F.col(written).desc(), F.col("highest_bid").desc()])


def archive(existing: DataFrame, incoming: DataFrame, uuid: str = "uuid") -> DataFrame:
    """Existing and incoming auctions by normalised UUID: the higher bid stays, of equal bids the new
    one; rows whose UUID is none go."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)))
    both = both.withColumn(uuid, identity.normal_uuid(F.col(uuid))).where(F.col(uuid).isNotNull())
    return best_per_key(both, [uuid], [F.col("highest_bid").desc(), F.col("_v").desc()]).drop("_v")


def participations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By player, auction and type; the new entry wins."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)))
    return best_per_key(both, ["player", "auction_uid", "type"], [F.col("_v").desc(), F.col("end_ts").desc()]).drop("_v")


def combine_versions(versions: DataFrame, key: str = "uuid", order: str = "version") -> DataFrame:
    """Versions of an auction folded into one, in ``order``.

    The first version leads; what it lacks (no start, a starting bid of 0, category UNKNOWN, a profile
    equal to the seller) comes from the next that has it. Bids are joined, the first of each amount;
    the highest bid is the largest of them, if there are any. A single version stays as it is.
    """
    o = F.col(order)
    first = lambda c, ok: F.coalesce(F.min_by(F.col(c), F.when(ok, o)), F.max_by(F.col(c), o))
    amount = F.col("highest_bid")
    head = versions.groupBy(key).agg(
        F.count("*").alias("n_versions"),
        F.min_by("seller", o).alias("seller"),
        F.min_by("tag", o).alias("tag"),
        first("start_ts", F.col("start_ts").isNotNull()).alias("start_ts"),
        first("starting_bid", F.col("starting_bid") != 0).alias("starting_bid"),
        first("category", F.col("category") != "UNKNOWN").alias("category"),
        first("profile", ~F.col("profile").eqNullSafe(F.col("seller"))).alias("profile"),
        F.min_by(amount, o).alias("_high"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), F.col("bids").alias("b")))), lambda x: F.transform(x["b"], lambda b: b["amount"]))).alias("_amounts"),
    )
    amounts = F.array_distinct("_amounts")
    out = head.withColumn("n_bids", F.when(F.col("n_versions") > 1, F.size(amounts)).otherwise(F.size("_amounts")))
    return out.withColumn("highest_bid", F.when((F.col("n_versions") > 1) & (F.size("_amounts") > 0), F.array_max("_amounts")).otherwise(F.col("_high"))).drop("_high", "_amounts")


def retrofit(sold: DataFrame, unsold: DataFrame, days: int = 14) -> DataFrame:
    """Sold rows that lack a start, completed from the stored unsold row of the same UUID and tag whose end
    lies less than ``days`` before or after; of several that which ended last. One row per sold row.

    The columns RETROFITTED that both have are taken. The stored side is read between the least and the
    greatest end of the batch only: where it is stored by month, those bounds are known before its
    folders are listed, so others are not read.
    """
    taken = [c for c in RETROFITTED if c in sold.columns and c in unsold.columns]
    lacking = F.col("start_ts").isNull() & F.col("uuid").isNotNull() & F.col("tag").isNotNull()
    span = F.expr(f"INTERVAL '{days}' DAY")
    wanted = sold.where(lacking).select(F.col("uuid").alias("_uuid"), F.col("tag").alias("_tag"), F.col("end_ts").alias("_at")).distinct()
    bound = lambda f, by: wanted.select(by(f("_at"))).scalar()
    old = unsold.where((F.col("end_ts") > bound(F.min, lambda e: e - span)) & (F.col("end_ts") < bound(F.max, lambda e: e + span)))
    if "month" in unsold.columns:
        old = old.where((F.col("month") >= bound(F.min, lambda e: timekey.month(e - span))) & (F.col("month") <= bound(F.max, lambda e: timekey.month(e + span))))
    near = (F.col("end_ts") > F.col("_at") - span) & (F.col("end_ts") < F.col("_at") + span)
    met = old.join(wanted, (F.col("uuid") == F.col("_uuid")) & (F.col("tag") == F.col("_tag")) & near)
    best = met.groupBy("_uuid", "_tag", "_at").agg(F.max(F.struct("end_ts", *taken)).alias("_old"))
    same = lacking & (F.col("uuid") == F.col("_uuid")) & (F.col("tag") == F.col("_tag")) & (F.col("end_ts") == F.col("_at"))
    rows, found = sold.join(best, same, "left"), F.col("_old").isNotNull()
    return rows.select(*[F.when(found, F.col("_old")[c]).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in sold.columns])


def without_range(rows: DataFrame, tag: str, time_key: int, sold: bool, start: str, end: str) -> DataFrame:
    """All rows but those of one partition that ended in (start, end]."""
    gone = (F.col("tag") == tag) & (F.col("time_key") == time_key) & (F.col("is_sold") == sold) & (F.col("end_ts") > F.lit(start).cast("timestamp_ntz")) & (F.col("end_ts") <= F.lit(end).cast("timestamp_ntz"))
    return rows.where(~F.coalesce(gone, F.lit(False)))
