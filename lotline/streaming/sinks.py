"""Sinks that fail on their own: a bad row or a sink that is down does not stop the rest.

A batch goes to each sink by itself. If a sink fails, the batch's range of row hashes is cut in halves
until what fails is a single row (for that the batch is written once more, sorted by hash); that goes to the table of dead rows with its error, all others are
written. If a sink fails on everything it is given at first, it is taken to be down: the batch is kept
aside and tried again with later batches, after one, two, three, ... of them. Each sink has a log of its
outcomes. A batch that comes again skips the sinks that are done and replaces what others had begun, so
every row is written once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row hashes are in [0, SPAN).
SPAN = 1 << 62
#: Parts in a row that must fail, with none written, before a sink counts as down.
DOWN_AFTER = 6
OUTCOME = "sink string, batch long, status string, written long, dead long, tries int, due long"
DEAD = "sink string, batch long, row string, error string"


@dataclass(frozen=True)
class Outcome:
    sink: str
    batch: int
    status: str  # done or down
    written: int
    dead: int
    tries: int = 1
    due: int = -1


class Down(Exception):
    """A sink failed on all that it was given."""


class Sinks:
    """``sinks``: name to a function of (rows, folder) that writes ``rows`` into ``folder``, a new one, or
    raises. What they write is at path/out/sink/batch=N."""

    def __init__(self, spark: SparkSession, path: str, sinks: dict[str, Callable[[DataFrame, str], None]]):
        self.spark, self.path, self.sinks = spark, path.rstrip("/"), sinks

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def outcomes(self) -> DataFrame:
        """The last outcome of every sink and batch."""
        last = self._table("outcomes", OUTCOME).groupBy("sink", "batch").agg(F.max(F.struct("tries", "status", "written", "dead", "due")).alias("o"))
        return last.select("sink", "batch", "o.status", "o.written", "o.dead", "o.tries", "o.due")

    def dead(self) -> DataFrame:
        return self._table("dead", DEAD + ", part string").select("sink", "batch", "row", "error")

    def written(self, sink: str) -> DataFrame:
        """What ``sink`` wrote as Parquet, over all batches."""
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.path}/out/{sink}")

    def write(self, rows: DataFrame, batch: int) -> list[Outcome]:
        """Give ``rows`` to all sinks, then try again what is due by now."""
        before = {r["sink"]: r for r in self.outcomes().where(F.col("batch") == batch).collect()}
        out = []
        for name in self.sinks:
            if name not in before:
                out.append(self._give(name, rows, batch, 1, batch))
        for r in self.outcomes().where((F.col("status") == "down") & (F.col("due") <= batch) & (F.col("batch") < batch)).orderBy("sink", "batch").collect():
            if r["sink"] in self.sinks:
                kept = self.spark.read.parquet(f"{self.path}/aside/{r['sink']}/batch={r['batch']}")
                out.append(self._give(r["sink"], kept, r["batch"], r["tries"] + 1, batch))
        return out

    def _give(self, name: str, rows: DataFrame, batch: int, tries: int, now: int) -> Outcome:
        top, aside = f"{self.path}/out/{name}/batch={batch}", f"{self.path}/aside/{name}/batch={batch}"
        for x in (top, f"{self.path}/dead/part={name}-{batch}", f"{self.path}/cut/{name}"):
            self._delete(x)  # of a try that was lost
        keyed = rows.withColumn("_slot", F.pmod(F.xxhash64(F.to_json(F.struct(*rows.columns))), F.lit(SPAN)))
        state = {"failed": 0, "written": 0, "dead": 0}
        try:
            self._part(name, keyed, batch, 0, SPAN, state)
            result = Outcome(name, batch, "done", state["written"], state["dead"], tries)
        except Down:
            self._delete(top)
            self._delete(f"{self.path}/dead/part={name}-{batch}")
            if tries == 1:
                rows.write.mode("overwrite").parquet(aside)
            result = Outcome(name, batch, "down", 0, 0, tries, now + tries)
        self._delete(f"{self.path}/cut/{name}")
        self.spark.createDataFrame([(result.sink, result.batch, result.status, result.written, result.dead, result.tries, result.due)], OUTCOME).write.mode("append").parquet(f"{self.path}/outcomes")
        if result.status == "done" and tries > 1:
            self._delete(aside)
        return result

    def _sorted(self, name: str, keyed: DataFrame) -> DataFrame:
        """``keyed`` as files sorted by hash: to read a range of hashes takes what it holds, so all the cuts
        that lead to a bad row read about twice the batch together."""
        path = f"{self.path}/cut/{name}"
        keyed.repartitionByRange("_slot").sortWithinPartitions("_slot").write.parquet(path)
        return self.spark.read.parquet(path)

    def _part(self, name: str, keyed: DataFrame, batch: int, low: int, high: int, state: dict) -> None:
        """Write the rows whose hash is in [low, high)."""
        rows = keyed if (low, high) == (0, SPAN) else keyed.where((F.col("_slot") >= low) & (F.col("_slot") < high))
        folder = f"{self.path}/out/{name}/batch={batch}/part={low:016x}-{high:016x}"
        try:
            self.sinks[name](rows.drop("_slot"), folder)
        except Exception as e:  # whatever a sink raises is its outcome
            self._delete(folder)
            state["failed"] += 1
            if (low, high) == (0, SPAN):
                rows = keyed = self._sorted(name, keyed)
            n, least, most = rows.agg(F.count("*"), F.min("_slot"), F.max("_slot")).first()
            if least == most and n:  # one row, or copies of one
                error = str(e).strip().splitlines()[0][:1024] if str(e).strip() else type(e).__name__
                dead = rows.select(F.lit(name).alias("sink"), F.lit(batch).cast("long").alias("batch"), F.to_json(F.struct(*[c for c in rows.columns if c != "_slot"])).alias("row"), F.lit(error).alias("error"))
                dead.write.mode("append").parquet(f"{self.path}/dead/part={name}-{batch}")
                state["dead"] += n
                return
            if not state["written"] and state["failed"] >= DOWN_AFTER:
                raise Down(name) from e
            if n:
                middle = (least + most + 1) // 2
                self._part(name, keyed, batch, low, middle, state)
                self._part(name, keyed, batch, middle, high, state)
            return
        state["written"] += rows.count()
