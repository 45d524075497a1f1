"""An archive by tag and month that is merged when it is written.

A batch rewrites the folders (tag, month) that it touches, under a new version, and leaves the others. A
manifest names the version of every folder; it is written last and appears under its number in one step,
so a reader sees all of a batch or nothing, and a batch that is lost half way leaves only files that no
manifest names. A source's batches are numbered; the manifest keeps each source's last number, so a
batch that comes again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.functions import identity, timekey
from lotline.operators import merge

MANIFEST = "tag string, month string, version long, source string, batch long"
FOLDER = ["tag", "month"]


class MonthArchive:
    """The archive at ``path``, of rows with uuid, tag, end_ts and highest_bid. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        """Numbers of the manifests, ascending."""
        fs, at = self._fs(f"{self.path}/manifest")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()) if fs.exists(at) else []

    def manifest(self, number: int | None = None) -> DataFrame:
        """Of the latest manifest, or of that of a ``number``: a row per folder, and a row per source."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{known[-1] if number is None else number}")

    def read(self) -> DataFrame:
        """The archived rows, with their month. Bounds on tag and month prune folders."""
        folders = self.manifest().where("tag is not null").select(*FOLDER, "version")
        if folders.isEmpty():
            raise ValueError(f"nothing is archived at {self.path}")
        rows = self.spark.read.parquet(f"{self.path}/data").withColumn("version", F.col("version").cast("long"))
        return rows.join(folders, [*FOLDER, "version"]).drop("version")

    def merge(self, rows: DataFrame, source: str, batch: int) -> bool:
        """Merge batch ``batch`` of ``source`` in: in each folder, by normalised UUID, the higher bid stays, of
        equal bids the new row; rows without a valid UUID or an end are left out. A null tag is 'unknown'. Of
        rows of one batch the last written counts if they have a write_ts. False if the batch is there already."""
        known = self.versions()
        now = self.manifest()
        if known and not now.where((F.col("source") == source) & (F.col("batch") >= batch)).isEmpty():
            return False
        number = known[-1] + 1 if known else 1
        new = rows.withColumn("uuid", identity.normal_uuid(F.col("uuid"))).where("uuid is not null and end_ts is not null")
        new = new.withColumn("tag", F.coalesce("tag", F.lit("unknown"))).withColumn("month", timekey.month(F.col("end_ts")))
        # one pass of its own: the rows themselves are worked out when they are written, not again for the manifest
        touched = new.select(*FOLDER).distinct().persist()
        newest = [F.col("write_ts").desc()] if "write_ts" in rows.columns else []
        both = new.withColumn("_v", F.lit(1))
        if not now.where("tag is not null").isEmpty():
            old = self.read().join(touched, FOLDER, "left_semi").withColumn("_v", F.lit(0))
            both = old.unionByName(both, allowMissingColumns=True)
        # stored and new rows are shuffled once for both comparisons
        both = both.repartition(*FOLDER, "uuid")
        both = merge.best_per_key(both, [*FOLDER, "uuid", "_v"], [*newest, F.col("highest_bid").desc()])
        both = merge.best_per_key(both, [*FOLDER, "uuid"], [F.col("highest_bid").desc(), F.col("_v").desc()]).drop("_v")
        out = both.withColumn("version", F.lit(number)).repartitionByRange(*FOLDER, "end_ts", "uuid").sortWithinPartitions(*FOLDER, "end_ts", "uuid")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDER, "version").parquet(f"{self.path}/data")
        kept = now.join(touched, FOLDER, "left_anti").where((F.col("source") != source) | F.col("source").isNull())
        mark = self.spark.createDataFrame([(None, None, None, source, batch)], MANIFEST)
        added = touched.select(*FOLDER, F.lit(number).cast("long").alias("version"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("batch"))
        part = f"{self.path}/manifest/part-{uuid.uuid4().hex}"
        kept.unionByName(added).unionByName(mark).write.parquet(part)
        touched.unpersist()
        fs, at = self._fs(part)
        if not fs.rename(at, self._fs(f"{self.path}/manifest/{number}")[1]):
            raise RuntimeError(f"version {number} of {self.path} was written meanwhile")
        return True

    def tidy(self, keep: int = 2) -> int:
        """Delete manifests before the last ``keep`` and the folders that only they name; how many folders."""
        known = self.versions()
        drop, stay = known[:-keep], known[-keep:]
        if not drop:
            return 0
        named = self.manifest(stay[0])
        for n in stay[1:]:
            named = named.unionByName(self.manifest(n))
        old = self.manifest(drop[0])
        for n in drop[1:]:
            old = old.unionByName(self.manifest(n))
        gone = old.where("tag is not null").select(*FOLDER, "version").distinct().join(named.select(*FOLDER, "version"), [*FOLDER, "version"], "left_anti")
        n_gone = 0
        names = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for r in gone.toLocalIterator():
            fs, at = self._fs(f"{self.path}/data/tag={names.escapePathName(r['tag'])}/month={r['month']}/version={r['version']}")
            n_gone += bool(fs.delete(at, True))
        for n in drop:
            fs, at = self._fs(f"{self.path}/manifest/{n}")
            fs.delete(at, True)
        return n_gone
