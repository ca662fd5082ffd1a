"""Actor mentions, claims and their attribution by patterns: rows per span, joined on the document."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that make a capitalised span an organisation.
ORG_HINTS = ("ministry", "government", "university", "institute", "agency", "department", "committee", "council", "greenpeace", "company", "corp", "inc", "ltd", "gmbh")
# The patterns of spans, quotes and reported speech.
CAPITALISED = r"\b([A-Z][\w\-']+(?:\s+[A-Z][\w\-']+)+)\b"
QUOTES = (r"“([^”]+)”", r'"([^"]+)"', r"‘([^’]+)’")
REPORTED = (
    (r"\b(?:According to|according to)\s+([^,]+?),\s+([^\.!?]+)", 2),
    (r"\b([A-Z][^,\.;:]{0,80}?)\s+(?:said|says|stated|claimed|told|argued|added|noted|asserted)\s+(?:that\s+)?([^\.!?]+)", 2),
)

# Verbs that name a quote's speaker after or before it, and how far away they may stand.
SAID, NEAR = "said|says|stated|told|added", 120

SPANS = "kind string, start long, end long, span string, confidence double"


def _spans(text: str):
    """(kind, start, end, span, confidence): mentions, then claims, one per (kind, start, end), the first wins."""
    seen = set()
    for m in re.finditer(CAPITALISED, text):
        org = any(h in m[1].lower() for h in ORG_HINTS)
        yield ("ORG" if org else "PERSON", m.start(1), m.end(1), m[1], 0.6 if org else 0.7)
    for kind, patterns, confidence in (("QUOTE", [(p, 1) for p in QUOTES], 0.9), ("REPORTED", REPORTED, 0.7)):
        for p, g in patterns:
            for m in re.finditer(p, text):
                said = m[g].strip().strip(",;: ")
                if kind == "QUOTE" and (len(said) < 8 or not re.search(r"\s", said)):
                    continue
                if m.span(g) not in seen:
                    seen.add(m.span(g))
                    yield (kind, *m.span(g), said, confidence)


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, start, end, span, confidence): PERSON and ORG mentions, QUOTE and REPORTED claims; no shuffle."""

    def run(batches):
        for b in batches:
            rows = [(i, *s) for i, t in zip(b["id"], b["text"]) for s in _spans(t or "")]
            yield pd.DataFrame(rows, columns=["id", "kind", "start", "end", "span", "confidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"id {kind}, {SPANS}").withColumnRenamed("id", id_col)


def nearest_before(claims: DataFrame, mentions: DataFrame, doc: str, at: str, start: str, name: str) -> DataFrame:
    """Each claim with the mention of its document that starts last at or before it (null without one).

    An as-of join as one sort per document: mentions and claims in one stream, the last mention carried forward.
    """
    left = claims.select("*", F.col(at).alias("_at"), F.lit(1).alias("_claim"), F.lit(None).cast(mentions.schema[name].dataType).alias("_name"))
    right = mentions.select(doc, F.col(start).alias("_at"), F.lit(0).alias("_claim"), F.col(name).alias("_name"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = W.partitionBy(doc).orderBy("_at", "_claim", F.col("_name")).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("speaker", F.last("_name", ignorenulls=True).over(w))
    return both.filter("_claim = 1").drop("_at", "_claim", "_name")


def overlapping(a: DataFrame, b: DataFrame, doc: str) -> DataFrame:
    """Pairs of spans (start, end) of the same document that overlap: (doc, start, end, other_start, other_end)."""
    o = b.select(doc, F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return a.join(o, doc).filter((F.col("end") > F.col("other_start")) & (F.col("start") < F.col("other_end")))


def within_sentence(claims: DataFrame, mentions: DataFrame, doc: str, sentence: str) -> DataFrame:
    """Each claim with a mention of its own sentence: one that precedes it first, then the one that starts last."""
    m = mentions.select(doc, sentence, F.col("start").alias("m_start"), F.col("span").alias("speaker"))
    d = claims.join(m, [doc, sentence], "left")
    rank = F.row_number().over(W.partitionBy(doc, "start", "end").orderBy((F.col("m_start") <= F.col("start")).desc_nulls_last(), F.desc("m_start"), "speaker"))
    return d.withColumn("_r", rank).filter("_r = 1").drop("_r", "m_start")


def named_by_verb(claims: DataFrame, docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Claims with `by_verb`: who the text right after a quote, else right before it, says has said it (null if nobody)."""
    d = claims.join(docs.select(doc, F.col(text).alias("_text")), doc, "left")
    after = F.expr(f"substring(_text, cast(end as int) + 1, {NEAR})")
    before = F.expr(f"substring(_text, cast(greatest(0, start - {NEAR}) as int) + 1, cast(least(start, {NEAR}) as int))")
    trimmed = lambda c: F.nullif(F.regexp_replace(c, r"^[,\s]+|[,\s]+$", ""), F.lit(""))
    right = trimmed(F.regexp_extract(after, rf"^[\"”’,\s]*(?:{SAID})\s+([^.;:]+)", 1))
    left = trimmed(F.regexp_extract(before, rf"([^.;:]+?)\s+(?:{SAID})[,:\s\"“‘]*$", 1))
    return d.withColumn("by_verb", F.when(F.col("kind") == "QUOTE", F.coalesce(right, left))).drop("_text")


def attribution(claims: DataFrame, mentions: DataFrame, doc: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """Claims with their speaker and its confidence: quotes .85 by a verb next to them (with docs), else .55, and reported
    speech .7 by the nearest preceding mention."""
    d = nearest_before(claims, mentions, doc, "start", "start", "span")
    sure = F.when(F.col("speaker").isNotNull(), F.when(F.col("kind") == "QUOTE", 0.55).otherwise(0.7))
    if docs is None:
        return d.withColumn("attribution_confidence", sure)
    d = named_by_verb(d, docs, doc).withColumn("attribution_confidence", F.when(F.col("by_verb").isNotNull(), 0.85).otherwise(sure))
    return d.withColumn("speaker", F.coalesce("by_verb", "speaker")).drop("by_verb")
