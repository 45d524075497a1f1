"""Counters of an ingest, taken while its rows pass: no pass over the data is made for them.

The numbers are observed in the plans of the batch's own writes. A listener hears of the progress of
each batch and appends a row to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lotline.operators import filters

TABLE = "query string, batch long, name string, value long"


def observed(events: DataFrame, name: str = "ingest") -> DataFrame:
    """``events`` as they come, counted: all, junk, and those without a uuid that are not junk."""
    junk = F.coalesce(filters.junk(), F.lit(False))
    some = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return events.observe(name, F.count("*").alias("rows_in"), some(junk).alias("junk"), some(~junk & F.col("uuid").isNull()).alias("without_uuid"))


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``rows`` with a count of them that is known once they are written."""
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias(name)), seen


class MetricsTable(StreamingQueryListener):
    """Appends the metrics that batches report to the table at ``path``. One row a metric and batch; a batch
    that is reported again is counted once by metrics()."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path, self.more, self.run, self.early = spark, path, {}, None, []

    def follow(self, query: StreamingQuery) -> StreamingQuery:
        """Listen to ``query`` only, until it ends."""
        self.run = str(query.runId)
        for p in self.early:
            self._write(p)
        return query

    def add(self, batch: int, **values: int) -> None:
        """Counts of a batch that the listener will write with what is observed."""
        self.more.setdefault(batch, {}).update(values)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) == self.run:
            self.spark.streams.removeListener(self)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if self.run is None:
            self.early.append(event.progress)
        else:
            self._write(event.progress)

    def _write(self, p) -> None:
        if str(p.runId) != self.run:
            return
        values = {k: v for row in p.observedMetrics.values() if row is not None for k, v in row.asDict().items()} | self.more.pop(p.batchId, {})
        if p.numInputRows:
            rows = [(str(p.id), p.batchId, k, int(v)) for k, v in values.items()] + [(str(p.id), p.batchId, "batch_ms", int(p.batchDuration))]
            self.spark.createDataFrame(rows, TABLE).coalesce(1).write.mode("append").parquet(self.path)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """query, batch, name, value, each once."""
    return spark.read.schema(TABLE).parquet(path).groupBy("query", "batch", "name").agg(F.max("value").alias("value"))


def settled(spark: SparkSession) -> None:
    """Wait until all that was reported so far is written."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
