"""Late completion of a stream: sold events that lack a start wait, in keyed state, for the unsold event
of the same auction.

Auctions (uuid and tag) are dealt to buckets by hash. Per bucket the state holds the unsold events and the
sold ones that still wait, so a batch takes a few calls to the state for a bucket instead of several for
each auction, and one timer, for what is due next. A sold event with a start of its own comes out at once; one without is completed at once from the unsold event that ended
last (of equal ends that with the greater JSON text), of those less than DAYS before or after its own
end, else by the first batch that brings one, else
it comes out as it is when its timer fires, DAYS after its end by the watermark. So each comes out once.
Within a batch unsold events count first. State goes when nothing can meet it any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lotline.operators.merge import RETROFITTED

DAYS = 14
#: Keys of the state, fixed for the life of a checkpoint. A batch reads the state of the buckets that it meets.
BUCKETS = 1 << 12
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
DAY_MS = 86_400_000


class Completion(StatefulProcessor):
    """Events are (end in ms, uuid, tag, JSON): the state needs no more of them, and no value passes through pandas."""

    def __init__(self, days: int):
        self.window = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.unsold = handle.getListState("unsold", "ms long, uuid string, tag string, event string")
        self.waiting = handle.getListState("waiting", "ms long, uuid string, tag string, event string")

    def _hold(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _wake(self, rows: list[tuple]) -> None:
        """A timer for the first of ``rows`` that is due; later ones are seen to when it fires."""
        if rows:
            self.handle.registerTimer(min(r[0] for r in rows) + self.window)

    def _out(self, rows: list[tuple[str, str | None]]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["event", "other"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, sold, out = [], [], []
        for part in rows:
            for is_sold, whole, *row in zip(part["is_sold"], part["whole"], part["ms"].astype("int64").tolist(), part["uuid"], part["tag"], part["event"]):
                if is_sold and whole:
                    out.append((row[-1], None))
                else:
                    (sold if is_sold else new).append(tuple(row))
        waiting = [tuple(r) for r in self.waiting.get()] if new else []
        if not new and not sold:
            yield from self._out(out)
            return
        # of unsold events those of the auctions that sold ones are completed for
        wanted, known = {r[1:3] for r in [*waiting, *sold]}, {}
        if wanted:
            for r in [*(self.unsold.get() if sold else []), *new]:
                if tuple(r[1:3]) in wanted:
                    known.setdefault(tuple(r[1:3]), []).append((r[0], r[3]))
        if new:
            self.unsold.appendList(new)
        kept = []
        for r in [*waiting, *sold]:
            near = [u for u in known.get(r[1:3], ()) if abs(u[0] - r[0]) < self.window]
            if near:
                out.append((r[3], max(near)[1]))
            else:
                kept.append(r)
        if new and kept != waiting:
            self._hold(self.waiting, kept)
        elif not new and kept:
            self.waiting.appendList(kept)
        self._wake([*new, *kept])
        yield from self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, due = timerValues.getCurrentWatermarkInMs(), []
        left = []
        for state in (self.waiting, self.unsold):
            rows = [tuple(r) for r in state.get()]
            stay = [r for r in rows if r[0] + self.window > now]
            if len(stay) < len(rows):
                self._hold(state, stay)
                due += [(r[3], None) for r in rows if r[0] + self.window <= now] if state is self.waiting else []
            left += stay
        self._wake(left)
        yield from self._out(due)

    def close(self) -> None:
        pass


def completed(events: DataFrame, days: int = DAYS, delay: str = "14 days", buckets: int = BUCKETS) -> DataFrame:
    """The sold ``events`` (uuid, tag, is_sold, end_ts as an instant, start_ts, ...), each once, with the columns
    RETROFITTED of the unsold one where one was found. Events that end more than ``delay`` before the last
    end seen are too late, as for every watermark: auctions end up to two weeks after they are listed.
    Events without uuid, tag or end belong to no auction."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema
    rows = events.where("uuid is not null and tag is not null and end_ts is not null").withWatermark("end_ts", delay)
    rows = rows.select(F.pmod(F.xxhash64("uuid", "tag"), F.lit(buckets)).alias("bucket"), "uuid", "tag", "end_ts", F.coalesce("is_sold", F.lit(False)).alias("is_sold"), F.col("start_ts").isNotNull().alias("whole"), F.unix_millis("end_ts").alias("ms"), F.to_json(F.struct(*events.columns), JSON).alias("event"))
    out = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Completion(days), outputStructType="event string, other string", outputMode="append", timeMode="eventTime")
    both = out.select(F.from_json("event", kind, JSON).alias("e"), F.from_json("other", kind, JSON).alias("o"))
    return both.select(*[F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"e.{c}")).alias(c) if c in RETROFITTED else F.col(f"e.{c}").alias(c) for c in events.columns])


def last_event(events: DataFrame, days: int = DAYS) -> DataFrame:
    """One unsold event, later than every timer of ``events`` (a batch): it lets a stream that has ended come to
    its end, and never comes out itself."""
    end = events.agg((F.max("end_ts") + F.make_dt_interval(F.lit(4 * days))).alias("end_ts"))
    fixed = {"end_ts": F.col("end_ts"), "uuid": F.lit(""), "tag": F.lit(""), "is_sold": F.lit(False)}
    return end.select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
