"""Named filters as column expressions, so that they are pushed to the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[[str], Column]] = {
    "Reforge": lambda v: F.lower(F.element_at("nbt", "modifier")) == v.lower(),
    "Stars": lambda v: F.element_at("nbt", "upgrade_level").try_cast("int") == int(v),
    "Enchantment": lambda v: F.coalesce(F.map_contains_key("enchantments", v.lower()), F.lit(False)),
    "Bin": lambda v: F.col("bin") == (v.lower() == "true"),
    "Seller": lambda v: F.col("seller") == F.lit(v).try_cast("long"),
    "Tier": lambda v: F.col("tier") == v,
    "MinPrice": lambda v: F.col("highest_bid") >= int(v),
    "EndAfter": lambda v: F.col("end_ts") > F.timestamp_seconds(F.lit(int(v))).cast("timestamp_ntz"),
    "EndBefore": lambda v: F.col("end_ts") < F.timestamp_seconds(F.lit(int(v))).cast("timestamp_ntz"),
}


def compiled(filters: dict[str, str]) -> Column:
    """All of ``filters`` (name: value); unknown names raise."""
    out = F.lit(True)
    for name, value in filters.items():
        if name not in REGISTRY:
            raise ValueError(f"unknown filter {name}")
        out = out & REGISTRY[name](value)
    return out


def of_users(users: list[str]) -> Column:
    """Seller, or any bidder, is among ``users``, trimmed and whatever the case."""
    names = [u.strip().lower() for u in users]
    return F.lower(F.col("seller").cast("string")).isin(*names) | F.exists("bids", lambda b: F.lower(b["bidder"].cast("string")).isin(*names))


def junk() -> Column:
    """Rows not worth keeping: nobody sells, or neither a tag nor a bid."""
    return F.col("seller").isNull() & F.col("tag").isNull() & (F.coalesce("highest_bid", F.lit(0)) == 0)
