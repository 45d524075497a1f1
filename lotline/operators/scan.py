"""Scans of auctions: ranges, lookups, pages, tiers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import timekey


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def in_range(rows: DataFrame, start: str, end: str, tag: str | None = None) -> DataFrame:
    """Auctions with start < end_ts <= end. If ``rows`` has the columns time_key or month, they are
    bounded too, which Spark turns into partition pruning."""
    out = rows.where((F.col("end_ts") > ntz(start)) & (F.col("end_ts") <= ntz(end)))
    if tag is not None:
        out = out.where(F.col("tag") == tag)
    if "time_key" in rows.columns and tag is not None:
        out = out.where(F.col("time_key").between(timekey.time_key(F.lit(tag), ntz(start)), timekey.time_key(F.lit(tag), ntz(end))))
    if "month" in rows.columns:
        out = out.where(F.col("month").between(start[:7], end[:7]))
    return out


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` auctions that ended last."""
    return rows.orderBy(F.col("end_ts").desc(), F.col("auction_uid").desc()).limit(n)


def page(rows: DataFrame, after: int, n: int) -> DataFrame:
    """Up to ``n`` rows with ids beyond ``after``, in order."""
    return rows.where(F.col("auction_uid") > after).orderBy("auction_uid").limit(n)


def tiers(hot: DataFrame, cold: DataFrame, cutoff: str) -> DataFrame:
    """Archived auctions up to ``cutoff`` and recent ones after it; what either lacks comes from the
    other; every auction once, the recent copy if both have it on its side of the cutoff."""
    side = F.when(F.col("end_ts") > ntz(cutoff), "hot").otherwise("cold")
    both = hot.withColumn("_from", F.lit("hot")).unionByName(cold.withColumn("_from", F.lit("cold"))).withColumn("_pref", (F.col("_from") == side).cast("int"))
    w = Window.partitionBy("uuid").orderBy(F.col("_pref").desc(), "_from")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_pref", "_r").withColumnRenamed("_from", "origin")


def overview(rows: DataFrame, as_of: str, n: int = 12) -> DataFrame:
    """The newest ``n`` of the last hour, or if there are fewer, of the last 13 days and 1 hour."""
    ended = rows.where(F.col("end_ts") <= ntz(as_of))
    hour = F.col("end_ts") > ntz(as_of) - F.expr("INTERVAL '1' HOUR")
    top = newest(ended.where(F.col("end_ts") > ntz(as_of) - F.expr("INTERVAL '13 01' DAY TO HOUR")).withColumn("_hour", hour), n)
    enough = F.sum(F.col("_hour").cast("int")).over(Window.partitionBy()) >= n  # over n rows
    return top.withColumn("_enough", enough).where("_hour or not _enough").drop("_hour", "_enough")


def ranked(rows: DataFrame, by: list[str], order: list[str], part: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 in their group ``by``, in ascending ``order``. Each group is ranked in
    parts, by ``part``, which must not fall where the order rises: a hot group takes as many tasks as it has
    parts, and only the number of rows of each part is summed up in one."""
    cut = rows.withColumn("_part", part)
    sizes = cut.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_part"]]
    match = same[0]
    for x in same[1:]:
        match = match & x
    both = cut.withColumn(name, within).alias("a").join(sizes.alias("b"), match)
    return both.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col(f"a.{name}") + F.col("b._before")).alias(name))


def chunks(rows: DataFrame, by: list[str], n: int, ids: int = 1 << 16) -> DataFrame:
    """Each group cut into chunks of ``n`` rows by id, counted from 0; ranked by ranges of ``ids`` ids."""
    out = ranked(rows, by, ["auction_uid"], F.call_function("div", "auction_uid", F.lit(ids)), "_r")
    return out.withColumn("chunk", F.floor((F.col("_r") - 1) / n).cast("int")).drop("_r")


def every_nth(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Each group's n-th, 2n-th, ... row by end and id; ranked by hours of end."""
    return ranked(rows, by, ["end_ts", "auction_uid"], F.date_trunc("hour", "end_ts"), "_r").where(F.col("_r") % n == 0).drop("_r")


def remaining(rows: DataFrame, probed: list[str]) -> DataFrame:
    """The months of ``rows`` that are not ``probed`` yet, with how many rows each has."""
    months = rows.select(timekey.month(F.col("end_ts")).alias("month"))
    return months.where(~F.col("month").isin(*probed)).groupBy("month").agg(F.count("*").alias("rows"))


@dataclass
class Budget:
    """A scan that stops early: the months of the archive and of the recent tier that it takes rows from,
    the time keys of the latter, and how many partitions it looked at."""

    archived: list[str] = field(default_factory=list)
    recent: list[str] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    looked_at: int = 0
    found: int = 0


def spend(hot: DataFrame, cold: DataFrame | None, tag: str, start: str, end: str, n: int, condition: Column) -> Budget:
    """Which partitions hold the ``n`` newest rows of ``tag`` with start < end_ts <= end that meet
    ``condition``: months of ``cold`` (by month), or where it has no sold row of a month in range, the time
    keys of ``hot`` (by tag and time_key) in that month.

    Months are looked at in order from the newest, in groups of one, two, four, ... until the budget is met,
    each group by a count of its partitions; what is older is never read.
    """
    plan, todo, size = Budget(), timekey.months_between(start, end)[::-1], 1
    following = dict(zip(todo[1:], todo[:-1]))
    ranged = (F.col("tag") == tag) & (F.col("end_ts") > ntz(start)) & (F.col("end_ts") <= ntz(end)) & F.col("is_sold")
    counts = [F.count("*").alias("rows"), F.sum(F.coalesce(condition, F.lit(False)).cast("long")).alias("meet")]
    while todo and plan.found < n:
        group, todo, size = todo[:size], todo[size:], 2 * size
        stored = {} if cold is None else {r["month"]: r["meet"] for r in cold.where(ranged & F.col("month").isin(group)).groupBy("month").agg(*counts).collect()}
        lacking = [m for m in group if m not in stored]
        keys = {m: timekey.keys_between(tag, max(start, f"{m}-01 00:00:00"), min(end, f"{following[m]}-01 00:00:00") if m in following else end)[::-1] for m in lacking}
        wanted = sorted({k for ks in keys.values() for k in ks})
        recent = {}
        if wanted:
            month = timekey.month(F.col("end_ts"))
            recent = {(r["month"], r["time_key"]): r["meet"] for r in hot.where(ranged & F.col("time_key").isin(wanted) & month.isin(lacking)).groupBy(month.alias("month"), "time_key").agg(*counts).collect()}
        for m in group:
            if plan.found >= n:
                break
            if m in stored:
                plan.archived.append(m)
                plan.found += stored[m]
                continue
            plan.recent.append(m)
            for k in keys[m]:
                if plan.found < n and (m, k) in recent:
                    plan.keys.append(k)
                    plan.found += recent[m, k]
        plan.looked_at += len(group) * (cold is not None) + len(wanted)
    return plan


def budgeted(hot: DataFrame, cold: DataFrame | None, tag: str, start: str, end: str, n: int, condition: Column | None = None) -> DataFrame:
    """The ``n`` newest sold rows of ``tag`` with start < end_ts <= end that meet ``condition``, by end and id;
    a month comes from the archive if that has any of it, else from the recent tier. Only the partitions
    that spend() finds are read. The columns are those that both have; origin says where a row is from."""
    condition = F.lit(True) if condition is None else condition
    plan = spend(hot, cold, tag, start, end, n, condition)
    wanted = (F.col("tag") == tag) & (F.col("end_ts") > ntz(start)) & (F.col("end_ts") <= ntz(end)) & F.col("is_sold") & condition
    both = [c for c in hot.columns if c != "time_key" and (cold is None or c in cold.columns)]
    rows = hot.where(wanted & F.col("time_key").isin(plan.keys) & timekey.month(F.col("end_ts")).isin(plan.recent)).select(*both, F.lit("hot").alias("origin"))
    if cold is not None:
        rows = rows.unionByName(cold.where(wanted & F.col("month").isin(plan.archived)).select(*both, F.lit("archive").alias("origin")))
    # the plan knows how many there are: a budget that was not met needs no limit, whatever its size
    return newest(rows, n) if plan.found > n else rows.orderBy(F.col("end_ts").desc(), F.col("auction_uid").desc())
