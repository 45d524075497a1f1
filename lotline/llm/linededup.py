"""Line deduplication over levelled sorted runs of line hashes.

The state is a set of runs: tables bucketed and sorted by line hash, each row a line's hash with the
number of documents and the largest document id that hold it. A batch is reduced to one row per line,
dealt like the runs, and merge-anti-joined with each of them, bucket by bucket and without shuffling a
run; it becomes a run of level 0, in which lines that no run had are marked as fresh. When a level has
``fanout`` runs they are merged into one run of the next level, so a batch meets only a logarithmic
number of runs and a row is rewritten once per level.

A manifest beside the runs names the runs and the batches they hold. It is written after a run is, so a
batch that is lost half way leaves no trace and one that is added again changes nothing; whoever opens
the path later goes on from there.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm.common import Scratch, exists, join_small, new_path, removed, unused, written

RUN = "h1 bigint, h2 bigint, n_docs bigint, max_doc bigint, fresh boolean"
MANIFEST = "version int, kind string, level int, item string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.length(bare) == F.octet_length(bare)  # no letters outside ASCII that lower() would change
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, least: int, *keep: Column | str) -> DataFrame:
    """Per line of ``docs`` whose key has ``least`` code points: keep, _pos (from 0), h1, h2.

    The length is tested on the bare line, which has as many code points as its key, so that keys are
    only made of lines that count.
    """
    each = docs.select(*keep, F.posexplode(lines(F.col("text"))).alias("_pos", "_line"))
    each = each.where((F.octet_length("_line") >= least) & (F.length(F.btrim("_line", F.lit(BLANKS))) >= least))
    k = key(F.col("_line"))
    return each.withColumn("h1", F.xxhash64(k)).withColumn("h2", F.xxhash64(k, F.lit(1))).drop("_line")


class LineRuns:
    """Runs in ``path``, a folder that all executors reach; what is there already is kept.

    ``buckets`` (the session's shuffle partitions unless given) and ``least_chars`` are fixed when a path
    is first used.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, least_chars: int = 40, fanout: int = 3, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "line-runs"), fanout
        self.version, self.batches, self.levels = 0, set(), [[]]
        self.least, self.buckets = least_chars, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not exists(spark, f"{self.path}/manifest"):
            self._commit()
            return
        rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        rows = rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version").orderBy("level", "item").collect()  # a row per run or batch
        for r in rows:
            self.version = r["version"]
            if r["kind"] == "batch":
                self.batches.add(r["item"])
            elif r["kind"] == "run":
                self._at(r["level"]).append(r["item"])
                self._declare(r["item"])
            else:
                self.least, self.buckets = (int(x) for x in r["item"].split(" "))

    def _at(self, level: int) -> list[str]:
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        return self.levels[level]

    def _commit(self) -> None:
        self.version += 1
        rows = [("settings", 0, f"{self.least} {self.buckets}"), *[("batch", 0, b) for b in sorted(self.batches)], *[("run", i, r) for i, runs in enumerate(self.levels) for r in runs]]
        df = self.spark.createDataFrame([(self.version, *r) for r in rows], MANIFEST).coalesce(1)
        df.drop("version").write.mode("overwrite").parquet(f"{self.path}/manifest/version={self.version}")

    def _table(self, run: str) -> str:
        return f"line_run_{run}"

    def _declare(self, run: str) -> None:
        """Tell this session's catalog of a run that another one wrote."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(run)} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs/{run}'")

    def _write(self, rows: DataFrame, level: int) -> None:
        run = uuid.uuid4().hex
        rows = rows.select(*[c.split(" ")[0] for c in RUN.split(", ")])
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):  # else they are dealt by bucket
            rows = rows.repartition(self.buckets, "h1", "h2")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/runs/{run}").saveAsTable(self._table(run))
        self._at(level).append(run)

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        removed(self.spark, *[f"{self.path}/runs/{run}" for run in runs])

    def _merged(self, runs: list[str]) -> DataFrame:
        """One row per line of ``runs``, read as plain files: Spark 4.1 takes a union of bucketed tables for
        one that is dealt by bucket even where it reads them without their buckets."""
        if not runs:
            return self.spark.createDataFrame([], RUN)
        rows = self.spark.read.schema(RUN).parquet(*[f"{self.path}/runs/{run}" for run in runs])
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.max("fresh").alias("fresh"))

    def batch(self, docs: DataFrame) -> DataFrame:
        """One row per line key of ``docs`` (doc_id, text). A line counts once a
        doc_id; all rows without an id are one document.

        Lines are first made distinct by document, dealt by line and document, and counted there, so
        that of a line that many documents hold only a row a task comes to where it is summed.
        """
        each = line_hashes(docs, self.least, "doc_id").select("h1", "h2", "doc_id").distinct()
        return each.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").cast("long").alias("max_doc"))

    def _unseen(self, batch: DataFrame) -> DataFrame:
        for run in itertools.chain(*self.levels):
            batch = batch.join(self.spark.table(self._table(run)).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return batch

    def fresh(self, docs: DataFrame) -> DataFrame:
        """The rows of batch() whose lines no run has yet: the merge-anti-join alone."""
        return self._unseen(self.batch(docs))

    def add(self, docs: DataFrame, name: str | None = None) -> bool:
        """Merge-anti-join a batch with the runs and add it as a run of its own; false, and nothing done,
        if a batch of that ``name`` is in already.

        Null and empty texts have no line that counts. Repeated rows count once; an empty batch is a run
        without rows. Columns other than doc_id and text are not read.
        """
        name = name or uuid.uuid4().hex
        if name in self.batches:
            return False
        with Scratch(self.spark, "line-batch") as at:
            batch = self.batch(docs)
            if any(self.levels):
                batch = at.written(batch, "batch")
                fresh = at.written(self._unseen(batch), "fresh")
                again = batch.join(fresh.select("h1", "h2"), ["h1", "h2"], "left_anti")
                batch = fresh.withColumn("fresh", F.lit(True)).unionByName(again.withColumn("fresh", F.lit(False)))
            else:
                batch = batch.withColumn("fresh", F.lit(True))
            self._write(batch, 0)
        self.batches.add(name)
        done, level = [], 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._write(self._merged(runs), level + 1)
            done += runs
            level += 1
        self._commit()
        self._forget(done)
        return True

    def totals(self) -> DataFrame:
        """One row per line that any run has: h1, h2, n_docs, max_doc."""
        runs = list(itertools.chain(*self.levels))
        rows = self.spark.table(self._table(runs[0])) if len(runs) == 1 else self._merged(runs)
        return rows.drop("fresh")

    def drop(self) -> None:
        """Delete the runs and their manifest."""
        self._forget(list(itertools.chain(*self.levels)))
        removed(self.spark, self.path)


def add_in_batches(runs: LineRuns, docs: DataFrame, batches: int) -> None:
    """Add ``docs`` (doc_id, text) in ``batches`` ranges of doc_id, the largest ids first, so that
    the holder of a line is nearly always known from the first run that has it. A batch is named by its
    range: a call that was cut off can be repeated."""
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []))
    for low, high in reversed(list(zip([None, *cuts], [*cuts, None]))):
        part = F.lit(True)
        if low is not None:
            part = part & (F.col("doc_id") > low)
        if high is not None:
            part = part & (F.col("doc_id") <= high)
        if low is None:  # with null ids
            part = F.coalesce(part, F.lit(True))
        runs.add(docs.where(part), f"({low}, {high}]")


def drop_lines(docs: DataFrame, runs: LineRuns, min_docs: int) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the text of the lines that stay.

    A line whose key has at least ``runs.least`` code points and is held by ``min_docs`` ids or more
    goes from every row but those of the largest doc_id that holds it. Order and other lines stay as
    they are; a null text is one empty line. Rows equal in id and text are treated alike; rows with a
    null id never hold a line against one that has an id. Columns named like the results are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept")
    hash_, gone_, id_ = unused(docs, "_text", "_gone", "_id")
    common = written(runs.totals().where(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc"), "common-lines")
    each = line_hashes(docs, runs.least, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    # a line may be in most documents: the common ones are broadcast while they are few, else dealt in salts
    found = join_small(each, common.withColumn("_common", F.lit(True)), ["h1", "h2"], F.col("_t"))
    found = found.where(F.col("_common") & ~F.col("_id").eqNullSafe(F.col("max_doc")))
    found = found.groupBy(F.col("_id").alias(id_), F.col("_t").alias("_same")).agg(F.collect_set("_pos").alias(gone_))
    found = written(found, "line-places")  # from here on the runs are not needed
    mine = docs.withColumn(hash_, F.xxhash64("text"))
    out = mine.join(found.withColumnRenamed("_same", f"{hash_}_same"), mine["doc_id"].eqNullSafe(found[id_]) & (F.col(hash_) == F.col(f"{hash_}_same")), "left")
    every, gone = lines(F.col("text")), F.col(gone_)
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone)
    kept = F.when(gone.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(every, i)), "\n"))
    n = F.when(gone.isNull(), 0).otherwise(F.size(gone))
    return out.select(*docs.columns, F.size(every).cast("long").alias("n_lines"), n.cast("long").alias("n_dropped"), kept.alias("kept"))
