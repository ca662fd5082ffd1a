"""Texts to chunks: one row per document in, one row per chunk out, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import CONNECTORS, strip, text_of

MARK = "\x01"

# How a text says, right after a closing quote, who has said it; without case.
ATTRIBUTIONS = (
    r'["”]\s*,?\s*(said|added|told|asked|replied|explained|stated|mentioned|noted)\b',
    r'["”]\s*,?\s*(according to|explained by|stated in|noted by|mentioned by|reported by)\b',
    r'["”]\s*,?\s*(as stated by|in the words of|per the report)\b',
    r'per month["”]\s*,?\s*(the report mentioned|it said|they stated)\b',
)
#: A sentence ends after one of these, if a line end, a capital (with or without a space) or a quote follows.
BOUNDARY = r'([.!?])(?=\s*\n|\s+[A-Z]|[A-Z]|\s*["”])'


def sentences(text: Column | str, most_chars: int | None = 500) -> Column:
    """Array of trimmed sentences of at most most_chars characters, or of any length; blank ones are dropped."""
    parts = F.split(F.regexp_replace(text_of(text), BOUNDARY, f"$1{MARK}"), MARK)
    cut = F.transform(parts, lambda s: strip(s) if most_chars is None else strip(F.substring(strip(s), 1, most_chars)))
    return F.filter(cut, lambda s: s != "")


def explode_chunks(docs: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """keep, chunk_id (ordinal), chunk."""
    return docs.select(*keep, F.posexplode(chunks).alias("chunk_id", "chunk"))


def sentence_chunks(docs: DataFrame, *keep: str, text: str = "text", most_chars: int | None = 500) -> DataFrame:
    return explode_chunks(docs, sentences(text, most_chars), *keep)


def packed(text: Column | str, most_words: int = 80) -> Column:
    """Array of chunks packed greedily from whole sentences, paragraph by paragraph.

    At a paragraph's start a chunk of half of most_words or more ends. A sentence of more than most_words is cut
    to that many, with an ellipsis unless it ends a sentence, and stands alone. Else a sentence joins if it fits; up to
    110 % if it opens with a connector or attributes a quote; or if it is under 12 words and the chunk under half full.
    A quoted text of at most most_words is one chunk as it stands.
    """
    t = text_of(text)
    paragraphs = F.filter(F.split(t, r"\n\s*\n"), lambda p: strip(p) != "")
    # (sentence, words, opens a paragraph) of the whole text
    items = F.flatten(F.transform(paragraphs, lambda p: F.transform(sentences(p, 1 << 30), lambda s, i: F.struct(s.alias("s"), F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")).alias("n"), (i == 0).alias("opens")))))
    # The fold needs its items by name: a one-element transform binds them.
    bound = F.transform(F.array(items), lambda it: F.aggregate(
        it, F.expr("named_struct('out', cast(array() as array<string>), 'cur', '', 'n', 0)"), lambda a, x: _step(a, x, most_words),
        lambda a: F.when(a["n"] > 0, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"])))[0]
    quoted = t.contains('"') & (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) <= most_words)
    return F.when(quoted, F.array(t)).otherwise(bound)


def _step(a: Column, x: Column, most_words: int) -> Column:
    s, n = x["s"], x["n"]
    state = lambda out, cur, m: F.struct(out.alias("out"), cur.alias("cur"), m.alias("n"))
    flush = (a["n"] > 0) & x["opens"] & (a["n"] * 2 >= most_words)
    out = F.when(flush, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"])
    cur = F.when(flush, "").otherwise(a["cur"])
    m = F.when(flush, 0).otherwise(a["n"])
    first = F.regexp_replace(F.lower(F.regexp_extract(s, r"^(\S+)", 1)), r"[.,!?:;]+$", "")
    said = reduce(lambda a, b: a | b, (s.rlike(f"(?i){p}") for p in ATTRIBUTIONS))
    joins = (m + n <= most_words) | ((m + n <= most_words * 1.1) & (first.isin(*CONNECTORS) | said)) | ((n < 12) & (m * 2 < most_words))
    words = F.array_join(F.slice(F.filter(F.split(s, r"\s+"), lambda w: w != ""), 1, most_words), " ")
    words = F.when(words.rlike("[.!?]$"), words).otherwise(F.concat(words, F.lit("...")))
    ended = F.when(m > 0, F.concat(out, F.array(cur))).otherwise(out)
    none = F.lit(0)
    return (
        F.when(n > most_words, state(F.concat(ended, F.array(words)), F.lit(""), none))
        .when(m == 0, state(out, s, n))
        .when(joins, state(out, F.concat(cur, F.lit(" "), s), m + n))
        .otherwise(state(F.concat(out, F.array(cur)), s, n))
    )


def windows(docs: DataFrame, id_col: str, text: str, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """(id, piece): character windows of the trimmed text that back off to the last space beyond 40 % of the limit, with an overlap."""

    def pieces(t: str) -> Iterator[str]:
        t, at = t.strip(), 0
        while at < len(t):
            end = min(len(t), at + limit)
            if end < len(t):
                space = t.rfind(" ", at + int(limit * 0.4) + 1, end)
                end = space if space > at else end
            yield t[at:end].strip()
            if end >= len(t):
                return
            at = end - overlap if end - overlap > at else end

    def run(batches):
        for b in batches:
            rows = [(i if k == 0 else f"{i}::chunk{k + 1:02d}", p) for i, t in zip(b["id"], b["text"]) for k, p in enumerate(x for x in pieces(t or "") if x)]
            yield pd.DataFrame(rows, columns=["passage_id", "passage"])

    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    return d.mapInPandas(run, "passage_id string, passage string")


def batches(rows: DataFrame, order: str, size: int, group: str) -> DataFrame:
    """(group, batch, n): rows of each group packed in order into batches of a fixed size."""
    n = F.row_number().over(W.partitionBy(group).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / size)).groupBy(group, "batch").agg(F.count("*").alias("n"))
