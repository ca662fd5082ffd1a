"""What is new since the last run: frontiers, rebuilds, caches, high-water marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import without


def frontier(discovered: DataFrame, stored: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Discovered and neither stored nor failed before."""
    return without(without(discovered, stored, [key]), failed, [key])


def outcomes(discovered: DataFrame, stored: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """(outcome, n): new, stored or failed."""
    d = discovered.select(key).distinct()
    d = d.join(stored.select(key).distinct().withColumn("_s", F.lit(True)), key, "left").join(failed.select(key).distinct().withColumn("_f", F.lit(True)), key, "left")
    return d.groupBy(F.when(F.col("_s"), "stored").when(F.col("_f"), "failed").otherwise("new").alias("outcome")).agg(F.count("*").alias("n"))


def needs_rebuild(current: DataFrame, state: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """Keys whose fingerprint or spec keys differ from the state's, or that it hasn't."""
    s = state.select(key, *(F.col(p).alias(f"_{p}") for p in parts))
    same = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts]
    d = current.join(s, key, "left")
    changed = ~same[0]
    for x in same[1:]:
        changed = changed | ~x
    return d.filter(changed).select(key)


def fresh(cache: DataFrame, at: str, now: Column, max_age: str) -> DataFrame:
    return cache.filter(F.col(at) >= now - F.expr(f"interval {max_age}"))


def high_water(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.max(column).alias("latest"))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows without those that come again, and the new ones."""
    return without(stored, new, [key]).unionByName(new)
