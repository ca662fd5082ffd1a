"""Classification metrics as grouped counts: a pass over the predictions, then a row per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def accuracy(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    return pairs.agg(F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"))


def per_class(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, support) of every label that is gold or predicted."""
    labels = F.explode(F.array_distinct(F.array(gold, predicted))).alias("label")
    c = pairs.groupBy(gold, predicted).agg(F.count("*").alias("n")).select(gold, predicted, "n", labels)
    hit = lambda g, p: F.sum(F.when((F.col(gold) == F.col("label")) == F.lit(g), F.when((F.col(predicted) == F.col("label")) == F.lit(p), F.col("n")).otherwise(0)).otherwise(0))
    c = c.groupBy("label").agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"))
    c = c.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.withColumn("f1", f1).withColumn("support", F.col("tp") + F.col("fn"))


def averages(classes: DataFrame) -> DataFrame:
    """One row: macro and weighted precision, recall and F1, micro (= accuracy), and micro_ref, the sums of support over predictions and gold."""
    out = []
    for m in ("precision", "recall", "f1"):
        out.append(F.avg(m).alias(f"macro_{m}"))
        out.append((F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}"))
    micro = F.sum("tp") / F.sum("support")
    return classes.agg(*out, micro.alias("micro"), (F.sum("support") / F.sum(F.col("tp") + F.col("fp"))).alias("micro_ref"))


def confusion(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """(gold, predicted, n), dense over all labels; the grid has a row per pair of labels."""
    n = pairs.groupBy(gold, predicted).agg(F.count("*").alias("n"))
    labels = n.select(F.explode(F.array(gold, predicted)).alias("l")).distinct()
    sets = labels.agg(F.array_sort(F.collect_list("l")).alias("ls"))
    grid = sets.select(F.explode("ls").alias(gold), "ls").select(gold, F.explode("ls").alias(predicted))
    return grid.join(n, [gold, predicted], "left").select(gold, predicted, F.coalesce("n", F.lit(0)).alias("n"))


def ranking(rows: DataFrame, by: str, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(by, precision, recall, f1, auc, support): AUC from rank sums with mean ranks for ties; zeros without both classes.

    Scores are counted first, so that a group's window runs over its distinct scores and not over its rows.
    """
    c = rows.groupBy(by, score).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("mean_rank", before + (F.col("n") + 1) / 2)
    hit = F.col(score) >= threshold
    g = c.groupBy(by).agg(
        F.sum("pos").alias("p"), F.sum("n").alias("all"), F.sum(F.col("pos") * F.col("mean_rank")).alias("ranks"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("called"),
    )
    both = (F.col("p") > 0) & (F.col("p") < F.col("all"))
    precision, recall = _ratio(F.col("tp"), F.col("called")), _ratio(F.col("tp"), F.col("p"))
    auc = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("all") - F.col("p")))
    g = g.select(by, *(F.when(both, x).otherwise(0.0).alias(n) for n, x in (("precision", precision), ("recall", recall), ("auc", auc))), F.col("p").alias("support"))
    return g.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best(rows: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """(by, n, best, mean): the name with the largest value, ties to the smallest name."""
    order = F.min_by(name, F.struct(-F.col(value), F.col(name)))
    return rows.groupBy(by).agg(F.count("*").alias("n"), order.alias("best"), F.avg(value).alias("mean"))


def argmax_label(probabilities) -> "F.Column":
    """Label of the largest probability in a map; ties to the first in alphabetical order."""
    entries = F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.array_min(entries)["k"]
