"""What the corpus operators share: the shared work folder, written tables, joins with small tables
and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rows = TypeVar("Rows", pd.DataFrame, pa.RecordBatch)
#: Rows up to which a narrow table counts as small enough to broadcast.
BROADCAST_ROWS = 50_000
#: Copies of a table that is joined with a skewed one and is too large to broadcast.
SALTS = 32


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session has none, as in tests, a temporary folder is set once. On a cluster that
    would be a folder of one machine, so a session there must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="lotline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return what is read back: cuts the lineage,
    and survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete work folders that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Work tables of one operator in a folder of their own, deleted together when its result is written.

    ``with Scratch(spark, name) as at: ... return at.result(df)``: the result stays in the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path, self.made = spark, name, new_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        removed(self.spark, self.path)

    def folder(self, name: str) -> str:
        self.made += 1
        return f"{self.path}/{name}-{self.made}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        return written(df, self.name)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Python workers get ``rows`` rows at a time unless the session says otherwise: texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def slices(rows: Rows, texts: list[str | None], chars: int = 1 << 20) -> Iterator[Rows]:
    """Parts of a batch of about ``chars`` characters of its ``texts``, a text of any length whole: what
    a worker makes of a text is many times its size."""
    upto = np.cumsum([len(t) if t is not None else 0 for t in texts])
    cuts = np.flatnonzero(np.diff(upto // chars)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        if b > a:
            yield rows.iloc[a:b] if isinstance(rows, pd.DataFrame) else rows.slice(a, b - a)


def unit(*cols: Column | str, seed: int = 0) -> Column:
    """A repeatable uniform number in (0, 1) for the row's ``cols``."""
    h = F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def join_small(big: DataFrame, small: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """Left join of a skewed ``big`` with ``small``, a written table with one row per key.

    ``small`` is counted: up to BROADCAST_ROWS rows it is broadcast; beyond that both sides are
    salted by ``spread``, so that a hot key is dealt to SALTS tasks. Null keys match null keys.
    """
    if small.count() <= BROADCAST_ROWS:
        small, extra = F.broadcast(small), []
    else:
        big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        extra = ["_salt"]
    right = small.select([F.col(c).alias(f"_r_{c}") if c in on + extra else F.col(c) for c in small.columns])
    match = F.lit(True)
    for c in on + extra:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return big.join(right, match, "left").drop(*[f"_r_{c}" for c in on + extra], *extra)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``node``, ``root``, the least id it reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a written table; the
    number of steps is about the logarithm of a component's diameter. Nothing is collected but two
    sums a step. The least neighbours are written before the edges are joined with them, so that Spark
    can split the edges of a node that has very many.
    """
    with Scratch(edges.sparkSession, name) as at:
        cur = at.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
        last = None
        while True:
            both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = at.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
            cur = at.written(small.where("u <> v").distinct(), "small")
            now = cur.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
            if tuple(now) == last:
                break
            last = tuple(now)
        roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return at.result(roots.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
