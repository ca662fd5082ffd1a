"""Document values to periods, domains and corpora, and their rolling series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def aggregate(docs: DataFrame, by: Sequence[str], how: str = "avg", keep_empty: bool = False, weighted: bool = True) -> DataFrame:
    """(by, frame, value, document_count) from weighted_documents or occurring_documents; null keys are dropped.

    avg: sum of value x weight over sum of weights; sum: the former over the mean weight. Documents without any frame
    are left out unless keep_empty. One partial aggregation, no join.
    """
    d = docs if keep_empty else docs.filter("any_value")
    for c in by:
        d = d.filter(F.col(c).isNotNull())
    w = F.when(F.col("total_weight") > 0, F.col("total_weight")).otherwise(1.0) if weighted else F.lit(1.0)
    top = F.sum(F.col("value") * w)
    value = top / F.sum(w) if how == "avg" else top / F.avg(w)
    return d.groupBy(*by, "frame").agg(value.alias("value"), F.count("*").alias("document_count"))


def aggregate_grid(docs: DataFrame, sets: Sequence[Sequence[str]], keep_empty: bool = False) -> DataFrame:
    """All groupings in one pass: (grouping columns, level, frame, value, document_count); level names the grouping."""
    d = docs if keep_empty else docs.filter("any_value")
    names = sorted({c for s in sets for c in s})
    sql_sets = [[F.col(c) for c in s] + [F.col("frame")] for s in sets]
    w = F.col("total_weight")
    g = d.groupingSets(sql_sets, *names, "frame").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"), F.count("*").alias("document_count"), F.grouping_id().alias("gid"))
    level = F.lit(None).cast("string")
    width = len(names) + 1
    for s in sets:
        gid = sum(1 << (width - 1 - k) for k, c in enumerate([*names, "frame"]) if c not in (*s, "frame"))
        level = F.when(F.col("gid") == gid, F.lit("+".join(s) or "global")).otherwise(level)
    return g.select(level.alias("level"), *names, "frame", "value", "document_count")


def dense_days(series: DataFrame, by: Sequence[str], day: str, value: str, own_bounds: bool = False) -> DataFrame:
    """Every day between the first and last (of the whole series, or of each key with own_bounds) for every key, 0-filled."""
    if own_bounds:
        b = series.groupBy(*by).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    else:
        ends = series.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))  # one row
        b = series.select(*by).distinct().join(F.broadcast(ends)) if by else ends
    grid = b.select(*by, F.explode(F.sequence("_a", "_b")).alias(day))
    return grid.join(series, [*by, day], "left").select(*by, day, F.coalesce(value, F.lit(0)).cast("double").alias(value))


def rolling_mean(series: DataFrame, by: Sequence[str], day: str, value: str, n: int) -> DataFrame:
    """Adds `rolling`: the mean of the last n rows of a dense series, fewer at its start.

    Windows are per key; a key's days are bounded by the calendar, not by the documents.
    """
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return series.withColumn("rolling", F.avg(value).over(w.orderBy(day).rowsBetween(1 - n, 0)))


def percent_of(value: Column, *by: str) -> Column:
    """Percent of the sum over the rows with the same keys."""
    return 100 * value / F.sum(value).over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
