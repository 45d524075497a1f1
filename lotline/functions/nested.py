"""Maps and arrays of auctions: bids, enchantments, attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def enrich_nbt(nbt: Column, anvil_uses: Column, reforge: Column) -> Column:
    """Attributes with ``anvil_uses`` (if positive) and ``modifier`` (if there is a reforge), where
    they lack them."""
    nbt = F.coalesce(nbt, F.create_map().cast("map<string,string>"))
    none = F.create_map().cast("map<string,string>")
    anvil = F.when((anvil_uses > 0) & ~F.map_contains_key(nbt, "anvil_uses"), F.create_map(F.lit("anvil_uses"), anvil_uses.cast("string"))).otherwise(none)
    forged = (F.coalesce(reforge, F.lit("None")) != "None") & ~F.map_contains_key(nbt, "modifier")
    return F.map_concat(nbt, anvil, F.when(forged, F.create_map(F.lit("modifier"), F.lower(reforge))).otherwise(none))


def enchantment_map(enchantments: Column) -> Column:
    """array<struct<type, level>> as a map; a type met again gets its position behind it."""
    named = F.transform(enchantments, lambda e, i: F.struct(F.when(F.exists(F.slice(enchantments, F.lit(1), i), lambda x: x["type"] == e["type"]), F.concat(e["type"], F.lit("#"), i.cast("string"))).otherwise(e["type"]).alias("key"), e["level"].alias("value")))
    return F.map_from_entries(named)


def map_text(m: Column) -> Column:
    """A map as text, keys sorted."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def top_bid(bids: Column) -> Column:
    """The bid with the largest amount; of equal ones the first."""
    best = F.array_max(F.transform(bids, lambda b: b["amount"]))
    return F.get(F.filter(bids, lambda b: b["amount"] == best), F.lit(0))


def write_time(bids: Column, start: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(bids, lambda b: b["ts"])), start)
