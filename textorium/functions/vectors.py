"""Vector, probability-map and score expressions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(xs, lambda x: F.exp(x - top) / total)


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def filled(probabilities: Column, frames: list[str]) -> Column:
    """All frames, missing ones 0, clamped to [0, 1] and scaled to sum 1 if there is anything."""
    pairs = F.array(*(F.struct(F.lit(f).alias("key"), clamped(F.coalesce(F.try_element_at(probabilities, F.lit(f)), F.lit(0.0))).alias("value")) for f in frames))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["value"])
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["key"], F.when(total > 0, x["value"] / total).otherwise(x["value"]))))


def utility(probabilities: Column, weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + w * F.coalesce(F.try_element_at(probabilities, F.lit(k)), F.lit(0.0))
    return out


def support_class(entails: Column, contradicts: Column, threshold: float = 0.7) -> Column:
    return F.when(entails > threshold, "entailment").when(contradicts > threshold, "contradiction").otherwise("neutral")


def valid_output(probabilities: Column, labels: list[str]) -> Column:
    """Exactly the labels as keys, every value in [0, 1]."""
    keys = F.array_sort(F.map_keys(probabilities)) == F.array(*map(F.lit, sorted(labels)))
    return keys & F.forall(F.map_values(probabilities), lambda p: (p >= 0) & (p <= 1))


def parsed_label(response: Column, labels: list[str], fallback: float = 0.1) -> Column:
    """(label, score) from a JSON answer with label and score or confidence, else from a label's mention in the text."""
    label = F.get_json_object(response, "$.label")
    score = F.coalesce(F.get_json_object(response, "$.score"), F.get_json_object(response, "$.confidence"), F.lit("0")).try_cast("double")
    found = F.lit(None).cast("string")
    for x in reversed(labels):
        found = F.when(F.lower(response).contains(x), F.lit(x)).otherwise(found)
    is_json = F.get_json_object(response, "$").isNotNull()
    return F.when(is_json, F.struct(label.alias("label"), clamped(F.coalesce(score, F.lit(0.0))).alias("score"))).otherwise(
        F.struct(found.alias("label"), F.when(found.isNotNull(), F.lit(fallback)).otherwise(0.0).alias("score"))
    )
