"""The archive: auctions by tag and month, as Parquet, or as gzipped JSON for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.functions import timekey


def write(rows: DataFrame, path: str, as_json: bool = False) -> None:
    """One folder per tag and month. Folders that ``rows`` touches are replaced, others stay, so the
    rows must not come from the folders they replace. Rows are dealt in ranges of tag, month and end, so
    a month that has very many is written by many tasks, each a range of its ends."""
    out = rows.withColumn("month", timekey.month(F.col("end_ts"))).repartitionByRange("tag", "month", "end_ts", "auction_uid").sortWithinPartitions("tag", "month", "end_ts", "auction_uid")
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag", "month")
    w.option("compression", "gzip").json(path) if as_json else w.parquet(path)


def read(spark: SparkSession, path: str, schema: str | None = None, as_json: bool = False) -> DataFrame:
    """Tag and month are partitions: bounds on them prune folders."""
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    if as_json:
        return spark.read.schema(schema).json(path)
    return spark.read.parquet(path)


def read_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array each, gzipped or not; the month comes from the file's name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("month", F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2})\.json(\.gz)?$", 1))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The files at ``path`` and below: key (what follows ``path``), length and modified; contents are not read.
    A tag and month are there if a key of theirs is."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.select(F.substring("path", F.instr("path", top + "/") + len(top) + 1, F.length("path")).alias("key"), "length", "modified")


def read_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, parts: int = 64) -> DataFrame:
    """A relational table in ``parts`` ranges of its id."""
    return spark.read.jdbc(url, table, column="id", lowerBound=low, upperBound=high, numPartitions=parts)
