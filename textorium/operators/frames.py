"""Frame scores: chunks to documents. Working form is long: a row per (document, frame)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import quoted, shortened, text_of, word_count

#: A lexical default for the annotator: a frame's probability is its share of the frames' words in a chunk.
LEXICON = {"access": ("the", "der", "le", "el"), "burden": ("and", "und", "et", "y"), "change": ("in", "en", "dans", "to"), "duty": ("of", "von", "des", "la")}


def lexical_scores(chunks: DataFrame, *keep: str, text: str = "chunk", lexicon: dict[str, Sequence[str]] = LEXICON) -> DataFrame:
    """(keep, frame_idx, frame, p, w): w is the chunk's words, one at least. Blank chunks don't count."""
    listed = [w for ws in lexicon.values() for w in ws]
    # One pass finds the listed tokens, in an explode of one row that later columns can't be folded into.
    whole = rf"(?<![\p{{L}}\p{{N}}])({'|'.join(sorted(map(quoted, listed), key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
    once = F.struct(F.regexp_extract_all(F.lower(text_of(text)), F.lit(whole), 1).alias("t"), word_count(text).alias("w"))
    d = chunks.select(*keep, F.explode(F.array(once)).alias("_x")).filter("_x.w > 0")
    count = lambda ws: F.size(F.filter("_x.t", lambda t: t.isin(*ws)))
    hits = F.array(*map(count, lexicon.values()))
    d = d.select(*keep, F.col("_x.w").alias("w"), F.explode(F.array(hits)).alias("_hits"))
    d = d.withColumn("_all", sum((F.col("_hits")[k] for k in range(len(lexicon))), F.lit(0)))
    names = F.array(*map(F.lit, lexicon))
    d = d.select(*keep, "w", "_all", F.posexplode("_hits").alias("frame_idx", "_n"), names.alias("_names"))
    p = F.when(F.col("_all") > 0, F.col("_n") / F.col("_all")).otherwise(0.0)
    return d.select(*keep, "frame_idx", F.col("_names")[F.col("frame_idx")].alias("frame"), p.alias("p"), "w")


def weighted_documents(scores: DataFrame, keys: Sequence[str], threshold: float = 0.0, normalize: bool = True, order: str | None = None) -> DataFrame:
    """(keys, frame_idx, frame, value, total_weight, any_value): words-weighted means over a document's chunks.

    Probabilities under the threshold count as 0 but stay in the denominator; with normalize a document's values
    are scaled to sum 1. any_value: the document has a frame at all. order: a column that orders a document's chunks;
    with it chunks are added up from the last to the first and frames in schema order, as DuckDB does, so that values
    are the same to the last bit wherever the rows lie.
    """
    passed = F.when((F.lit(threshold) <= 0) | (F.col("p") >= threshold), F.col("w") * F.col("p")).otherwise(0.0)
    by_keys = W.partitionBy(*keys)
    if order is None:
        top, frames = F.sum(passed), by_keys
    else:
        terms = F.collect_list(F.when(passed != 0, F.struct(order, passed.alias("x"))))
        top = F.aggregate(F.sort_array(terms, asc=False), F.lit(0.0), lambda total, t: total + t["x"])
        frames = by_keys.orderBy("frame_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = scores.groupBy(*keys, "frame_idx", "frame").agg((top / F.sum("w")).alias("value"), F.sum("w").cast("double").alias("total_weight"))
    total = F.sum("value").over(frames)
    d = d.withColumn("_sum", total)
    if normalize:
        d = d.withColumn("value", F.when(F.col("_sum") > 0, F.col("value") / F.col("_sum")).otherwise(F.col("value")))
    return d.withColumn("any_value", F.col("_sum") > 0).drop("_sum")


def occurring_documents(scores: DataFrame, keys: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """As weighted_documents, with 1 or 0: whether any chunk has the frame at the threshold and over 0; weight 1."""
    hit = F.when((F.col("p") >= threshold) & (F.col("p") > 0), 1.0).otherwise(0.0)
    d = scores.groupBy(*keys, "frame_idx", "frame").agg(F.max(hit).alias("value")).withColumn("total_weight", F.lit(1.0))
    return d.withColumn("any_value", F.max("value").over(W.partitionBy(*keys)) > 0)


def settled(value: Column | str) -> Column:
    """A share to rank by, in steps of 2^-35: far more than sums in another order differ by, so that equal shares tie."""
    return F.rint((F.col(value) if isinstance(value, str) else value) * float(1 << 35))


def top_frames(docs: DataFrame, keys: Sequence[str], k: int = 3, positive: bool = False, exact: bool = False) -> DataFrame:
    """(keys, rank, frame, value): the k best frames, ties in schema order. exact: values rank by their last bit, for sums of a fixed order."""
    d = docs.filter("value > 0") if positive else docs
    value = F.col("value") if exact else settled("value")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(value.desc(), "frame_idx"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= k).select(*keys, F.col("rank").cast("long").alias("rank"), "frame", "value")


def examples(scores: DataFrame, k: int, order: Sequence[str], text: str = "chunk", length: int = 160) -> DataFrame:
    """(frame, rank, order..., p, example): each frame's k best passages with p over 0, ties by `order`, cut at a word.

    Each task keeps its own k best before anything is shuffled.
    """
    rank = F.row_number().over(W.partitionBy("frame").orderBy(F.desc("p"), *order))
    best = scores.filter("p > 0").withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("frame", F.col("rank").cast("long").alias("rank"), *order, "p", shortened(text, length).alias("example"))


def as_maps(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, frame_scores): the map form, for the edges of the library."""
    pairs = F.array_sort(F.collect_list(F.struct("frame", "value")))
    return docs.groupBy(*keys).agg(F.map_from_entries(pairs).alias("frame_scores"))


def from_maps(rows: DataFrame, keys: Sequence[str], column: str = "frame_scores") -> DataFrame:
    return rows.select(*keys, F.explode(column).alias("frame", "value"))


