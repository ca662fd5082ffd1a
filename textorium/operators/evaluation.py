"""Scorers against datasets: pairs whose tasks meet, and all their metrics in one pass.

Cases: null or empty task sets meet nothing; a task listed twice counts once; an item without a prediction counts as wrong, with a null label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import _ratio


def matched(scorers: DataFrame, datasets: DataFrame, scorer: str, dataset: str, tasks: str = "tasks") -> DataFrame:
    """(scorer, dataset, shared): pairs with a task in common and their number of these, by an inverted index of tasks.

    The tasks of each side are rows that meet on equal tasks; a pair comes once for each task that it shares, not once for each pair of rows.
    """
    one = lambda d, name: d.select(name, F.explode(F.array_distinct(tasks)).alias("_task")).filter("_task is not null").distinct()
    return one(scorers, scorer).join(one(datasets, dataset), "_task").groupBy(scorer, dataset).agg(F.count("*").alias("shared"))


def evaluated(predictions: DataFrame, gold: DataFrame, scorer: str, dataset: str, item: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(scorer, dataset, n, accuracy, macro_f1): of every scorer on every dataset that it predicted anything of.

    predictions: (scorer, dataset, item, predicted); gold: (dataset, item, label). Counts by pair of labels are all that is grouped again.
    """
    pairs = predictions.select(scorer, dataset).distinct().join(gold.select(dataset, item, label), dataset)
    d = pairs.join(predictions.select(scorer, dataset, item, predicted), [scorer, dataset, item], "left")
    c = d.groupBy(scorer, dataset, label, predicted).agg(F.count("*").alias("_k"))
    right = F.sum(F.when(F.col(label) == F.col(predicted), F.col("_k")).otherwise(0))
    total = c.groupBy(scorer, dataset).agg(F.sum("_k").alias("n"), (right / F.sum("_k")).alias("accuracy"))
    each = c.select(scorer, dataset, label, predicted, "_k", F.explode(F.array_compact(F.array_distinct(F.array(label, predicted)))).alias("_l"))
    is_gold, is_said = F.col(label).eqNullSafe(F.col("_l")), F.col(predicted).eqNullSafe(F.col("_l"))
    count = lambda x: F.sum(F.when(x, F.col("_k")).otherwise(0))
    per = each.groupBy(scorer, dataset, "_l").agg(count(is_gold & is_said).alias("tp"), count(is_gold | is_said).alias("either"))
    macro = per.groupBy(scorer, dataset).agg(F.avg(_ratio(2 * F.col("tp"), F.col("tp") + F.col("either"))).alias("macro_f1"))
    return total.join(macro, [scorer, dataset])


def samples(predictions: DataFrame, gold: DataFrame, scorer: str, dataset: str, item: str, n: int, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The n wrong items of each scorer and dataset that come first by a hash of the item."""
    d = predictions.join(gold, [dataset, item]).filter(~F.col(label).eqNullSafe(F.col(predicted)))
    rank = F.row_number().over(W.partitionBy(scorer, dataset).orderBy(F.xxhash64(item), item))
    return d.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def binarised(rows: DataFrame, keys: list[str], score: str, threshold: float = 0.5, top: int | None = None, name: str = "on") -> DataFrame:
    """Rows with `name`: whether the score's sigmoid reaches the threshold or, with `top`, is among the best so many of its keys (ties by row order columns)."""
    p = 1 / (1 + F.exp(-F.col(score)))
    if top is None:
        return rows.withColumn(name, (p >= threshold).cast("int"))
    rest = [c for c in rows.columns if c not in (*keys, score)]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), *rest))
    return rows.withColumn(name, (rank <= top).cast("int"))


def multi_label(rows: DataFrame, label: str, truth: str, on: str) -> DataFrame:
    """One row: macro and micro precision, recall and F1 over labels."""
    c = rows.groupBy(label).agg(*(F.sum(x).cast("double").alias(n) for n, x in (("tp", F.col(truth) * F.col(on)), ("called", F.col(on)), ("real", F.col(truth)))))
    m = c.select(_ratio(F.col("tp"), F.col("called")).alias("p"), _ratio(F.col("tp"), F.col("real")).alias("r"), _ratio(2 * F.col("tp"), F.col("called") + F.col("real")).alias("f"))
    macro = m.agg(F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"))
    t = c.agg(F.sum("tp").alias("tp"), F.sum("called").alias("called"), F.sum("real").alias("real"))
    micro = t.select(_ratio(F.col("tp"), F.col("called")).alias("micro_precision"), _ratio(F.col("tp"), F.col("real")).alias("micro_recall"), _ratio(2 * F.col("tp"), F.col("called") + F.col("real")).alias("micro_f1"))
    return macro.crossJoin(micro)
