"""Candidates through several scorers, their utilities by policy, and the order that the first of these gives.

Cases: labels that a policy doesn't list count nothing; a candidate without scores has utility 0; equal utilities keep the candidates' own order; a
target without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rescored(candidates: DataFrame, scorers: Mapping[str, Callable[[Column, Column], Column]], target: str, passage: str, premise_is_target: bool = False) -> DataFrame:
    """With a map of label to probability per scorer, `score_<name>`.

    A scorer takes (premise, hypothesis): passages are premises and targets hypotheses, or the other way round with premise_is_target.
    """
    a, b = (target, passage) if premise_is_target else (passage, target)
    return candidates.withColumns({f"score_{name}": s(F.col(a), F.col(b)) for name, s in scorers.items()})


def utility(scores: Column, weights: Mapping[str, float]) -> Column:
    """The sum of the listed labels' probabilities by weight; 0 for null."""
    parts = [F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)) * F.lit(float(w)) for k, w in weights.items()]
    return F.coalesce(sum(parts, F.lit(0.0)), F.lit(0.0))


def reranked(scored: DataFrame, policies: Mapping[str, Mapping[str, float]], by: str, order: str, most: int | None = None) -> DataFrame:
    """With `utility_<name>` per policy, and `rank` among the target's (by) candidates: the first policy's utility, then `order`; the first `most` of each only."""
    d = scored.withColumns({f"utility_{n}": utility(F.col(f"score_{n}"), w) for n, w in policies.items()})
    d = d.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(f"utility_{next(iter(policies))}"), order)))
    return d if most is None else d.filter(F.col("rank") <= most)
