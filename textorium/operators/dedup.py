"""First and last rows per key, and differences of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the order, which must not tie."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_k", k).filter("_k = 1").drop("_k")


def last_by(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return first_by(rows, keys, F.desc(order))


def without(rows: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(taken.select(*keys), list(keys), "left_anti")


def present(rows: DataFrame, there: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(there.select(*keys), list(keys), "left_semi")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of a, those also in b, and their share."""
    marked = a.select(key).distinct().join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("n"), F.count("_b").alias("shared"), (F.count("_b") / F.count("*")).alias("share"))
