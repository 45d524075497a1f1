"""Identities: UUID text, item ids, storage keys."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL_PROFILE = "0" * 31 + "1"


def normal_uuid(text: Column) -> Column:
    """32 lower-case hexadecimal digits, or null for anything that is no UUID."""
    bare = F.lower(F.replace(F.trim(text), F.lit("-"), F.lit("")))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def auction_uid(uid: Column, uuid: Column) -> Column:
    """The own number unless it is missing or 0, else a hash of the UUID."""
    return F.coalesce(F.nullif(uid, F.lit(0).cast("long")), F.xxhash64(uuid))


def item_uid(hex_uid: Column) -> Column:
    return F.conv(hex_uid, 16, 10).cast("long")


def item_guid(uuid: Column, hex_uid: Column) -> Column:
    """The item's UUID, else its short id behind zeros."""
    short = F.lpad(F.right(F.lower(hex_uid), F.lit(12)), 12, "0")
    return F.coalesce(normal_uuid(uuid), F.concat(F.lit("0" * 20), short))


def bid_profile(profile: Column, bidder: Column) -> Column:
    return F.when(profile == "unknown", F.lit(SENTINEL_PROFILE)).otherwise(F.coalesce(profile, bidder))


def archive_key(tag: Column, month: Column) -> Column:
    return F.concat(F.lit("auctions/"), tag, F.lit("/"), month, F.lit(".json.gz"))


def archive_key_parts(key: Column) -> tuple[Column, Column]:
    """(tag, month) of a storage key, null where it is none."""
    pattern = r"^auctions/(.+)/(\d{4}-(?:0[1-9]|1[0-2]))\.json\.gz$"
    part = lambda i: F.nullif(F.regexp_extract(key, pattern, i), F.lit(""))
    return part(1), part(2)


def player_key(player: Column, year: Column) -> Column:
    return F.concat(F.lit("players/"), F.substring(player, 1, 2), F.lit("/"), player, F.lit("/"), year.cast("string"), F.lit(".json.gz"))


def normal_tier(tier: Column) -> Column:
    known = ["COMMON", "UNCOMMON", "RARE", "EPIC", "LEGENDARY", "MYTHIC", "DIVINE", "SPECIAL", "VERY_SPECIAL", "ULTIMATE"]
    same = F.replace(F.upper(tier), F.lit("SUPREME"), F.lit("DIVINE"))
    return F.when(same.isin(*known), same).otherwise(F.lit("UNKNOWN"))


def csv_field(value: Column) -> Column:
    """A field as RFC 4180 writes it; null is empty."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def filter_key(filters: Column) -> Column:
    """A name for a map of filters: keys sorted, time bounds left out, parts kept apart."""
    entries = F.filter(F.map_entries(filters), lambda e: ~e["key"].isin("EndAfter", "EndBefore"))
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def bloom_bits(entries: int, rate: float) -> int:
    """Size of a Bloom filter for ``entries`` at a false positive rate."""
    return math.ceil(-entries * math.log(rate) / math.log(2) ** 2)


def summary_days(text: str | None) -> float:
    """The ``days`` of a price request: 2 unless a number is given, at least 0, at most 2."""
    if text is None or not re.fullmatch(r"\s*[-+]?\d+(\.\d*)?\s*", text):
        return 2.0
    return min(2.0, max(0.0, float(text)))


def summary_days_column(text: Column) -> Column:
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.coalesce(text.try_cast("double"), F.lit(2.0))))
