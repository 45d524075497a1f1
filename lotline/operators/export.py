"""Exports of chosen columns as CSV, and the jobs that ask for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An instant with seven fractional digits.
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'"

def _yes_no(name: str) -> Callable[[], Column]:
    return lambda: F.when(F.col(name), "True").otherwise("False")


#: Columns by name, made when they are asked for: an expression needs a session.
COLUMNS: dict[str, Callable[[], Column]] = {
    "uuid": lambda: F.col("uuid"),
    "tag": lambda: F.col("tag"),
    "seller": lambda: F.col("seller").cast("string"),
    "highestbidamount": lambda: F.col("highest_bid").cast("string"),
    "bidcount": lambda: F.col("bid_count").cast("string"),
    "end": lambda: F.date_format("end_ts", ISO),
    "start": lambda: F.date_format("start_ts", ISO),
    "bin": _yes_no("bin"),
    "tier": lambda: F.col("tier"),
    "issold": _yes_no("is_sold"),
}
ALIASES = {"price": "highestbidamount"}
STATES = ("Pending", "InProgress", "Done", "Failed", "Aborted", "Deleted")


def selected(rows: DataFrame, columns: list[str], aliases: bool = False) -> DataFrame:
    """``columns`` by name, whatever their case; the header keeps the case asked for."""
    out = []
    for c in columns:
        name = c.lower()
        if aliases:
            name = ALIASES.get(name, name)
        if name not in COLUMNS:
            raise ValueError(f"invalid_column: {c}")
        out.append(COLUMNS[name]().alias(c))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header; as many files as there are partitions unless ``files`` asks for fewer."""
    rows = rows.coalesce(files) if files else rows
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


@dataclass(frozen=True)
class Job:
    email: str
    tag: str
    start: datetime
    end: datetime
    columns: tuple[str, ...] = ("uuid", "tag", "end", "highestbidamount")
    filters: dict[str, str] = field(default_factory=dict)
    status: str = "Pending"
    error: str = ""


def checked(job: Job, now: datetime) -> Job:
    """A valid job with its address normalised, or an error that says what is wrong."""
    if not job.email.strip() or not job.tag.strip():
        raise ValueError("missing_argument: email and tag are needed")
    if job.end <= job.start or job.end > now + timedelta(minutes=5):
        raise ValueError("invalid_range")
    if bad := [c for c in job.columns if c.lower() not in COLUMNS]:
        raise ValueError(f"invalid_column: {bad[0]}")
    return replace(job, email=job.email.strip().lower())


def run(job: Job, rows: DataFrame, path: str, files: int | None = None) -> Job:
    """Run a job into ``path``, as write_csv() does; a failure is its status, not an exception."""
    from lotline.operators import filters, scan

    try:
        wanted = {k: v for k, v in job.filters.items() if k not in ("EndAfter", "EndBefore")}
        part = scan.in_range(rows, f"{job.start:%Y-%m-%d %H:%M:%S}", f"{job.end:%Y-%m-%d %H:%M:%S}", job.tag).where(filters.compiled(wanted))
        write_csv(selected(part, list(job.columns)), path, files)
    except Exception as e:  # the job's table shows it
        return replace(job, status="Failed", error=str(e)[:1024])
    return replace(job, status="Done")
