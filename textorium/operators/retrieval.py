"""Exact vector search and two-stage rescoring.

Query blocks are broadcast and scored against the corpus in numpy, ROWS by ROWS, which keeps the best k of each task; only those
travel. A query set beyond BLOCK rows is run block by block, each block's best written to the shared folder before the
next is read, so that driver and executors hold one block at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written

#: Queries of a broadcast block; vectors, and queries, that are scored at once.
BLOCK, ROWS = 4096, 512


def top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of the largest cosine per query, ties to the smaller id.

    Vectors without length and queries without length match nothing.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    key = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    kinds = f"q {queries.schema[query_id].dataType.simpleString()}, i {vectors.schema[vector_id].dataType.simpleString()}, s double"
    spark = vectors.sparkSession
    parts = []
    for b in range(blocks):
        rows = queries.filter(key == b).select(query_id, vector).collect()  # a block of the stated query set
        ids = [r[0] for r in rows]
        q = _directions(np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0][1]) if rows else 0))
        held = spark.sparkContext.broadcast((ids, q))

        def run(batches, held=held):
            ids, q = held.value
            # The best so far, a row per query, best first; places that nothing took yet are below all scores.
            score, near, got = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=object), np.zeros(len(ids), dtype=np.int64)
            for b in batches:
                for at in range(0, len(b) if len(ids) else 0, ROWS):
                    x = b.iloc[at : at + ROWS]
                    v, vid = _directions(np.stack(x["v"].to_numpy()).astype(np.float64)), x["i"].to_numpy()
                    v, vid = v[~np.isnan(v[:, 0])], vid[~np.isnan(v[:, 0])]
                    if near.dtype == object and vid.dtype != object:
                        near = near.astype(vid.dtype)
                    for first in range(0, len(ids), ROWS):
                        s = q[first : first + ROWS] @ v.T
                        for j in np.flatnonzero((s >= score[first : first + ROWS, -1:]).any(axis=1)):
                            new, j = np.flatnonzero(s[j] >= score[first + j, -1]), first + j
                            both, who = np.append(score[j, : got[j]], s[j - first, new]), np.append(near[j, : got[j]], vid[new])
                            order = np.lexsort((who, -both))[:k]
                            got[j] = len(order)
                            score[j, : got[j]], near[j, : got[j]] = both[order], who[order]
            for first in range(0, len(ids), ROWS):
                some = [j for j in range(first, min(first + ROWS, len(ids))) if got[j]]
                if some:
                    who, best = (np.concatenate([a[j, : got[j]] for j in some]) for a in (near, score))
                    yield pd.DataFrame({"q": [ids[j] for j in some for _ in range(got[j])], "i": who, "s": best})

        part = vectors.select(F.col(vector_id).alias("i"), F.col(vector).alias("v")).mapInPandas(run, kinds)
        parts.append(part if blocks == 1 else written(_best(part, k), "nearest"))
    d = _best(reduce(DataFrame.union, parts), k)
    return d.select(F.col("q").alias(query_id), F.col("i").alias(vector_id), F.col("s").alias("score"), "rank")


def _directions(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; those without length to NaN."""
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.full_like(v, np.nan), where=size > 0)


def _best(d: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "i"))
    return d.select("q", "i", "s").withColumn("rank", rank).filter(F.col("rank") <= k)


def first_n(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def two_stage(candidates: DataFrame, by: str, item: str, first: Column, second: Column, keep: int = 10) -> DataFrame:
    """Candidates cut to the best `keep` per target by the first score, then ranked by the second."""
    d = first_n(candidates.withColumn("stage1", first), [by], [F.desc("stage1"), item], keep, "rank1")
    return d.withColumn("stage2", second).withColumn("rank2", F.row_number().over(W.partitionBy(by).orderBy(F.desc("stage2"), item)))


def realigned(candidates: DataFrame, scores: DataFrame, item: str, score: str, position: str) -> DataFrame:
    """Candidates with the score of their item that a rescorer gave first; zero if it gave none."""
    first = scores.groupBy(item).agg(F.min_by(score, position).alias(score))
    return candidates.join(first, item, "left").withColumn(score, F.coalesce(score, F.lit(0.0)))


def min_max(value: Column, *by: str) -> Column:
    """Scaled to [0, 1] among the rows with the same keys; 0.5 if all are equal."""
    w = W.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.5)


def ensemble(parts: Sequence[tuple[float, Column]]) -> Column:
    if abs(sum(w for w, _ in parts) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    return reduce(lambda a, b: a + b, (w * c for w, c in parts))
