"""Time keys: the number of whole periods since 2019, a week, or half a day for busy tags."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Start of counting (2019-01-01) and periods, in microseconds; tags with half-day keys
EPOCH = 1_546_300_800_000_000
WEEK, HALF_DAY = 604_800_000_000, 43_200_000_000
HALF_DAY_TAGS = ("ENCHANTED_BOOK", "unknown")


def period(tag: Column) -> Column:
    busy = tag.isNull() | tag.isin(*HALF_DAY_TAGS)
    return F.when(busy, F.lit(HALF_DAY)).otherwise(F.lit(WEEK))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_key(tag: Column, ts: Column) -> Column:
    """Truncates toward zero; dates before 2000-06-01 of busy tags have no key."""
    busy = tag.isNull() | tag.isin(*HALF_DAY_TAGS)
    key = F.call_function("div", micros(ts) - F.lit(EPOCH), period(tag)).cast("smallint")
    return F.when(~(busy & (ts < F.lit("2000-06-01").cast("timestamp_ntz"))), key)


def time_key_date(tag: Column, key: Column) -> Column:
    """Start of the period that ``key`` counts."""
    return F.timestamp_micros(F.lit(EPOCH) + key.cast("long") * period(tag)).cast("timestamp_ntz")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def months_apart(a: Column, b: Column) -> Column:
    return F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b))


def estimated_date(uid: Column) -> Column:
    """A guess from a running id: 30 million ids a year since June 2019."""
    return F.add_months(F.lit("2019-06-01").cast("date"), (12 * F.call_function("div", uid, F.lit(30_000_000))).cast("int"))


def keys_between(tag: str | None, start: str, end: str) -> list[int]:
    """The time keys from that of ``start`` to that of ``end``, on the driver."""
    step = HALF_DAY if tag is None or tag in HALF_DAY_TAGS else WEEK
    at = [int((datetime.fromisoformat(t).replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) - EPOCH for t in (start, end)]
    low, high = (abs(t) // step * (1 if t >= 0 else -1) for t in at)
    return list(range(low, high + 1))


def months_between(start: str, end: str) -> list[str]:
    """The months from that of ``start`` to that of ``end``, on the driver."""
    low, high = (12 * int(t[:4]) + int(t[5:7]) - 1 for t in (start, end))
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(low, high + 1)]


#: Forms in which people write dates and times, in the order in which they are tried.
FORMS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd[ HH:mm[:ss]]", "dd.MM.yyyy[ HH:mm[:ss]]", "MM/dd/yyyy[ HH:mm[:ss]]", "d MMM yyyy[ HH:mm[:ss]]")


def parsed(text: Column) -> Column:
    """A date or time as people write it, in UTC unless it names an offset; null if it is in none of FORMS.
    Dots mean the day is first, slashes that the month is; anything else of a number is seconds since 1970."""
    bare = F.trim(text)
    forms = [F.try_to_timestamp(bare, F.lit(f)) for f in FORMS]
    return F.coalesce(*forms, F.timestamp_seconds(F.when(bare.rlike("^[0-9]{9,11}$"), bare.try_cast("long")))).cast("timestamp_ntz")


def local_to_utc(ts: Column, zone: str) -> Column:
    """A local time of ``zone`` (timestamp_ntz) as UTC, summer time included. An hour that comes twice is
    taken as its second, in standard time, and one that is left out as if the clock had not been moved."""
    first = F.to_utc_timestamp(ts.cast("timestamp"), zone)
    second = first + F.expr("INTERVAL '1' HOUR")
    return F.when(F.from_utc_timestamp(second, zone) == ts.cast("timestamp"), second).otherwise(first).cast("timestamp_ntz")


def local_hours(ts: Column, zone: str) -> Column:
    """``ts`` less the whole hours of the offset that ``zone`` has then: how clocks were turned back where
    offsets of half an hour lose their minutes."""
    micros_ = micros(ts) - micros(local_to_utc(ts, zone))
    return F.timestamp_micros(micros(ts) - F.call_function("div", micros_, F.lit(3_600_000_000)) * 3_600_000_000).cast("timestamp_ntz")
