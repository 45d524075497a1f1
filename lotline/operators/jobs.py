"""The table of export jobs: a log of actions by job, of which the states follow.

The log is only appended to, so nothing is lost if a driver is: whatever runs jobs reads it again.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.operators import export

KEY = ["email", "requested_at", "job_id"]
#: What an action makes of a state; in any other state it is ignored.
MOVES = {
    "start": {"Pending": "InProgress"},
    "finish": {"InProgress": "Done"},
    "fail": {"InProgress": "Failed"},
    "abort": {"Pending": "Aborted", "InProgress": "Aborted"},
    "delete": {"Done": "Deleted", "Failed": "Deleted", "Aborted": "Deleted"},
}
SCHEDULED, ENDED = ("Pending", "InProgress"), ("Done", "Failed", "Deleted")


def save(actions: DataFrame, path: str) -> None:
    """Append ``actions`` (KEY, at, action) to the log; addresses are normalised."""
    actions.select(F.lower(F.trim("email")).alias("email"), *KEY[1:], "at", "action").write.mode("append").parquet(path)


def states(log: DataFrame) -> DataFrame:
    """KEY, status and changed_at of every job of ``log`` (KEY, at, action): its actions in order of
    time, equal ones once. A job is pending from its first action on; changed_at is when it took its
    state. A job has a handful of actions, so what is gathered of one is small.
    """
    to = F.create_map(*[F.lit(x) for action, moves in MOVES.items() for old, new in moves.items() for x in (f"{old} {action}", new)])
    steps = F.array_sort(F.collect_set(F.struct("at", "action")))
    jobs = log.groupBy(*KEY).agg(steps.alias("_steps"))
    first = F.struct(F.lit("Pending").alias("status"), F.col("_steps")[0]["at"].alias("changed_at"))

    def step(state, x):
        new = F.element_at(to, F.concat_ws(" ", state["status"], x["action"]))
        return F.struct(F.coalesce(new, state["status"]).alias("status"), F.when(new.isNotNull(), x["at"]).otherwise(state["changed_at"]).alias("changed_at"))

    return jobs.select(*KEY, F.aggregate("_steps", first, step).alias("_s")).select(*KEY, "_s.status", "_s.changed_at")


def listed(jobs: DataFrame, email: str, among: tuple[str, ...] | None = None) -> DataFrame:
    """The jobs of ``email``, newest first, or those ``among`` some states."""
    rows = jobs.where(F.col("email") == email.strip().lower())
    if among:
        rows = rows.where(F.col("status").isin(*among))
    return rows.orderBy(F.col("requested_at").desc(), "job_id")


ACTION = "email string, requested_at timestamp_ntz, job_id string, at timestamp_ntz, action string"


def run(job: export.Job, job_id: str, requested_at: datetime, rows: DataFrame, path: str, log: str, now: datetime | None = None) -> export.Job:
    """Run an export and say so in the ``log``: start, then finish or fail. A job that is not pending there any
    more (it was aborted, or has been run) is not run. What a lost run had written is replaced."""
    spark = rows.sparkSession
    instant = timedelta(microseconds=1)  # actions of one instant have no order
    act = lambda name, later: save(spark.createDataFrame([(job.email, requested_at, job_id, (now or datetime.now()) + later, name)], ACTION), log)
    mine = states(spark.read.schema(ACTION).parquet(log)).where((F.col("email") == job.email.strip().lower()) & (F.col("requested_at") == F.lit(requested_at).cast("timestamp_ntz")) & (F.col("job_id") == job_id))
    state = mine.first()
    if state is None or state["status"] not in SCHEDULED:
        return job
    if state["status"] == "Pending":
        act("start", 0 * instant)
    done = export.run(job, rows, path)
    act("finish" if done.status == "Done" else "fail", instant)
    return done
