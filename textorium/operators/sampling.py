"""Seeded samples: an order by a hash of seed and key, the same in every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def take(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in seeded order: a top-n per task, not a sort of everything."""
    return rows.withColumn("_o", order(seed, *keys)).orderBy("_o", *keys).limit(n).drop("_o")


def allocate(counts: DataFrame, group: str, total: int, seed: int, policy: str = "proportional") -> DataFrame:
    """(group, n, quota): total shared out equally or in proportion; what is left goes one each in seeded order.

    counts has a row per group (group, n); empty groups get 0.
    """
    c = counts.filter("n > 0")
    every = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = F.floor(F.lit(total) / F.count("*").over(every)) if policy == "equal" else F.floor(total * F.col("n") / F.sum("n").over(every))
    c = c.withColumn("base", share)
    c = c.withColumn("left", total - F.sum("base").over(every)).withColumn("turn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order(seed, group), group)))
    c = c.select(group, "n", (F.col("base") + (F.col("turn") <= F.col("left")).cast("long")).alias("quota"))
    return c.unionByName(counts.filter("n <= 0").select(group, "n", F.lit(0).cast("long").alias("quota")))


def stratified(rows: DataFrame, group: str, quotas: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """The first quota rows of each group in seeded order.

    Places in the order come from the count of rows in earlier hash buckets of the group, so that no group is sorted
    in one task.
    """
    d = rows.withColumn("_o", order(seed, *keys)).withColumn("_b", F.substring("_o", 1, 2))
    sizes = d.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before).drop("_n").join(quotas.select(group, "quota"), group)
    d = d.join(starts, [group, "_b"]).filter(F.col("_before") < F.col("quota"))
    place = F.col("_before") + F.row_number().over(W.partitionBy(group, "_b").orderBy("_o", *keys))
    return d.withColumn("_place", place).filter(F.col("_place") <= F.col("quota")).select(rows.columns)


def folds(rows: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """Adds fold 0 .. k - 1 in seeded order: n // k rows each, one more in the first n % k folds.

    A row's place is the count of rows in earlier hash buckets, of which there are 4,096 at any size, and its place in
    its own; equal keys and hashes are repeated rows, whose order doesn't matter.
    """
    d = rows.withColumn("_o", order(seed, *keys)).withColumn("_b", F.substring("_o", 1, 3))
    sizes = d.groupBy("_b").agg(F.count("*").alias("_n"))
    every = W.partitionBy(F.lit(0))
    before = F.sum("_n").over(every.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    starts = F.broadcast(sizes.select("_b", before.alias("_before"), F.sum("_n").over(every).alias("_all")))  # 4,096 rows at most
    d = d.join(starts, "_b").withColumn("_p", F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("_o", *keys)) - 1)
    small, more = F.floor(F.col("_all") / k), F.pmod(F.col("_all"), F.lit(k))
    large = more * (small + 1)
    fold = F.when(F.col("_p") < large, F.floor(F.col("_p") / (small + 1))).otherwise(more + F.floor((F.col("_p") - large) / F.greatest(small, F.lit(1))))
    return d.withColumn("fold", fold.cast("long")).select(*rows.columns, "fold")


def split(rows: DataFrame, seed: int, *keys: str, dev: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds part: train, dev or test by the seeded hash."""
    u = F.conv(F.substring(order(seed, *keys), 1, 8), 16, 10).cast("double") / 2**32
    return rows.withColumn("part", F.when(u < test, "test").when(u < test + dev, "dev").otherwise("train"))
