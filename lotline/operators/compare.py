"""Comparing stores: coverage, gaps, shadow reads, checks before deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shadow(left: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Per ``by``: keys in both, only left, only right."""
    a = left.select(key, *by).distinct().withColumn("_a", F.lit(1))
    b = right.select(key, *by).distinct().withColumn("_b", F.lit(1))
    one = lambda c: F.count(F.when(c, 1))
    both = a.join(b, [key, *by], "full_outer")
    return both.groupBy(*by).agg(one(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matches"), one(F.col("_b").isNull()).alias("left_only"), one(F.col("_a").isNull()).alias("right_only"))


def coverage(expected: DataFrame, archived: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Per ``by``: expected keys, archived rows, missing keys, and extra rows (unexpected or repeated)."""
    want = expected.select(key, *by).distinct().withColumn("_want", F.lit(1))
    have = archived.groupBy(key, *by).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    extra = F.when(F.col("_want").isNull(), n).otherwise(F.greatest(n - 1, F.lit(0)))
    return want.join(have, [key, *by], "full_outer").groupBy(*by).agg(F.count("_want").alias("expected"), F.sum(n).alias("archived"), F.count(F.when(F.col("_n").isNull(), 1)).alias("missing"), F.sum(extra).alias("extra"))


def gaps(expected: DataFrame, archived: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Number of expected keys that are not archived, where there are any."""
    return expected.join(archived.select(key).distinct(), key, "left_anti").groupBy(*by).agg(F.count("*").alias("missing"))


def verified(rows: DataFrame, archived: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows found in the archive, with ``same``: whether all ``fields`` agree."""
    kept = archived.select(key, *[F.col(c).alias(f"_k_{c}") for c in fields])
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(kept, key).select(*rows.columns, same.alias("same"))


def missing(rows: DataFrame, archived: DataFrame, key: str) -> DataFrame:
    return rows.join(archived.select(key), key, "left_anti")
