"""Continuous ingest: micro-batches of auctions into tables of auctions, bids and participations, and
the archive.

Each batch is cleaned, reduced to the last write per auction and appended, to every table, under its
batch number; a batch that is run again replaces its own files, so delivery is exactly once. Readers
fold what batches wrote by event time, so late and repeated events do no harm. The archive is merged
when it is written: a batch rewrites the folders that it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotline.operators import filters, merge, players
from lotline.sources import months
from lotline.streaming import metrics

EVENTS = "auction_uid long, uuid string, tag string, seller long, end_ts timestamp_ntz, start_ts timestamp_ntz, highest_bid long, write_ts timestamp_ntz, bids array<struct<bidder: bigint, amount: bigint, ts: timestamp_ntz>>"


def file_source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def kafka_source(spark: SparkSession, servers: str, topics: list[str], per_batch: int = 400) -> DataFrame:
    """Needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("maxOffsetsPerTrigger", per_batch).load()
    return decoded(raw)


def decoded(messages: DataFrame) -> DataFrame:
    """Events of ``messages`` (value: JSON as bytes). What is no JSON, or no object, is an event of nulls, which
    clean() leaves out and the counters tell of."""
    return messages.select(F.from_json(F.col("value").cast("string"), EVENTS).alias("e")).select("e.*")


def clean(events: DataFrame) -> DataFrame:
    rows = events.where(~filters.junk() & F.col("uuid").isNotNull())
    return rows.withColumn("tag", F.coalesce("tag", F.lit("unknown"))).withColumn("write_ts", F.coalesce("write_ts", "start_ts"))


def exploded(auctions: DataFrame) -> DataFrame:
    """The bids of ``auctions`` (EVENTS), a row each; repeated ones once."""
    rows = auctions.where("auction_uid is not null").select("auction_uid", F.explode("bids").alias("b"))
    return rows.select("auction_uid", "b.*").where("bidder is not null").distinct()


def start(events: DataFrame, path: str, checkpoint: str, mirror: bool = True) -> StreamingQuery:
    """Process all that is there, then stop; run again to go on from the checkpoint. Counters go to
    path/metrics; ``mirror`` merges each batch into the archive."""
    spark = events.sparkSession
    listener = metrics.MetricsTable(spark, f"{path}/metrics")
    spark.streams.addListener(listener)

    def batch(rows: DataFrame, number: int) -> None:
        last = merge.last_write(clean(rows), ["uuid"]).persist()
        kept, n_kept = metrics.counted(last.drop("bids"), "kept")
        bids, n_bids = metrics.counted(exploded(last), "bids")
        at = lambda name: f"{path}/{name}/batch={number}"
        kept.write.mode("overwrite").parquet(at("auctions"))
        bids.write.mode("overwrite").parquet(at("bids"))
        # the bids as they were written: they are not made distinct again
        written = last.sparkSession.read.schema(bids.schema).parquet(at("bids"))
        players.participations(last, written).write.mode("overwrite").parquet(at("participations"))
        listener.add(number, **n_kept.get, **n_bids.get)
        if mirror:
            months.MonthArchive(last.sparkSession, f"{path}/archive").merge(last, "ingest", number)
        last.unpersist()

    return listener.follow(metrics.observed(events).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current(spark: SparkSession, path: str) -> DataFrame:
    """The auctions as all batches leave them."""
    return merge.last_write(spark.read.parquet(f"{path}/auctions"), ["uuid"]).drop("batch")


def participations(spark: SparkSession, path: str) -> DataFrame:
    """By player, auction and type, the entry of the last batch that has it."""
    rows = spark.read.parquet(f"{path}/participations")
    return merge.best_per_key(rows, ["player", "auction_uid", "type"], [F.col("batch").desc(), F.col("end_ts").desc()]).drop("batch")


def archived(spark: SparkSession, path: str) -> DataFrame:
    """The archive that the batches leave; tag and month prune folders."""
    return months.MonthArchive(spark, f"{path}/archive").read()
