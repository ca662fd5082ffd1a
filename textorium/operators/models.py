"""Model steps as batched functions with deterministic defaults, and the parsing of model answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted

DIMENSION = 64


def hashed_vector(text: str | None, size: int = DIMENSION) -> list[float]:
    """Signed feature hashing of words, at unit length; zeros for no words."""
    v = np.zeros(size)
    for w in re.findall(r"\w+", (text or "").lower()):
        h = xxhash.xxh64_intdigest(w, 1)
        v[h % size] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def embedder(encode: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None):
    """A vectorised function text -> array<float>; `encode` is called once a batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode(texts.fillna("").tolist())) if encode else [hashed_vector(t) for t in texts])

    return embed


def overlap_scores(targets: Sequence[str], passages: Sequence[str]) -> list[dict[str, float]]:
    """A lexical stand-in for an entailment model: the share of the target's words that the passage has."""
    out = []
    for t, p in zip(targets, passages):
        a, b = set(re.findall(r"\w+", (t or "").lower())), set(re.findall(r"\w+", (p or "").lower()))
        share = len(a & b) / len(a) if a else 0.0
        denied = bool(b & {"not", "no", "never"}) != bool(a & {"not", "no", "never"})
        out.append({"entails": 0.0 if denied else share, "contradicts": share if denied else 0.0, "neutral": 1 - share})
    return out


def pair_scorer(score: Callable[[Sequence[str], Sequence[str]], Sequence[dict[str, float]]] = overlap_scores):
    """A vectorised function (target, passage) -> map of label to probability."""

    @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
    def scored(targets: pd.Series, passages: pd.Series) -> pd.Series:
        return pd.Series(list(score(targets.tolist(), passages.tolist())))

    return scored


ANSWERS = "array<struct<passage_id:string,probs:map<string,string>,top_frames:array<string>,rationale:string,evidence_spans:array<string>>>"


def parsed_annotations(response: Column, frames: Sequence[str], most_evidence: int = 3) -> Column:
    """Array of annotations of a model's JSON answer, in a code fence or not, one object or a list.

    Unknown frames and unreadable numbers are dropped, probabilities clamped, blank evidence removed; an answer that
    isn't JSON is an empty array.
    """
    body = F.regexp_replace(F.trim(response), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    body = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    known = F.array(*map(F.lit, frames))
    rows = F.coalesce(F.from_json(body, ANSWERS), F.array().cast(ANSWERS))
    rows = F.filter(rows, lambda r: r["passage_id"].isNotNull())
    number = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.try_cast("double")))
    return F.transform(rows, lambda r: F.struct(
        r["passage_id"].alias("passage_id"),
        F.transform_values(F.map_filter(r["probs"], lambda k, v: F.array_contains(known, k) & v.try_cast("double").isNotNull()), lambda k, v: number(v)).alias("probabilities"),
        F.filter(F.coalesce(r["top_frames"], F.array().cast("array<string>")), lambda f: F.array_contains(known, f)).alias("top_frames"),
        F.coalesce(r["rationale"], F.lit("")).alias("rationale"),
        F.slice(F.filter(F.coalesce(r["evidence_spans"], F.array().cast("array<string>")), lambda e: F.trim(e) != ""), 1, most_evidence).alias("evidence"),
    ))


def numbered_findings(answer: Column) -> Column:
    """Findings of a numbered list; else the paragraphs of more than 50 characters."""
    items = F.transform(F.regexp_extract_all(answer, F.lit(r"(?m)^\s*\d+[.)]\s+(.+?)\s*$"), F.lit(1)), lambda x: F.trim(x))
    paragraphs = F.filter(F.transform(F.split(answer, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 50)
    return F.when(F.size(items) > 0, items).otherwise(paragraphs)


def published(html: Column) -> Column:
    """Publication date of a page: a datetime attribute, article metadata, or JSON-LD."""
    found = [
        F.regexp_extract(html, r'(?i)<time[^>]*datetime="(\d{4}-\d{2}-\d{2})', 1),
        F.regexp_extract(html, r'(?i)<meta[^>]*(?:published_time|pubdate|date)"[^>]*content="(\d{4}-\d{2}-\d{2})', 1),
        F.regexp_extract(html, r'"datePublished"\s*:\s*"(\d{4}-\d{2}-\d{2})', 1),
    ]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found))


# What transcribers put in, what speakers do, and what opens another subject.
ARTEFACTS = ("[Music]", "[Applause]", "[Laughter]", "[Crowd noise]")
FILLERS = ("uh", "um", "ah", "oh")
TURNS = (
    "however", "nevertheless", "meanwhile", "furthermore", "moreover", "on the other hand", "in contrast", "additionally",
    "further", "now", "then", "next", "finally", "in conclusion",
)


def transcript(segments: Column, paragraph: int = 2) -> Column:
    """Transcript segments as a text: artefacts and fillers gone, points collapsed, sentences joined by a point and a space;
    a paragraph ends with its second sentence, or with one that holds a turn, anywhere in its words."""
    t = F.regexp_replace(F.array_join(F.transform(segments, lambda s: F.trim(s)), " "), r"\s+", " ")
    for x in ARTEFACTS:
        t = F.regexp_replace(t, f"(?i){quoted(x)}", "")
    t = F.regexp_replace(t, rf"(?i)\b(?:{'|'.join(FILLERS)})\b", "")
    for x in ".?!":
        t = F.regexp_replace(t, rf"[{x}]{{2,}}", x)
    parts = lambda x: F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    sentences = parts(F.array_join(parts(F.trim(t)), ". "))
    turn = lambda s: F.lower(s).rlike("|".join(map(quoted, TURNS)))
    state = lambda out, n: F.struct(out.alias("out"), n.alias("n"))
    return F.aggregate(
        sentences, state(F.lit(""), F.lit(0)),
        lambda a, s: state(
            F.concat(a["out"], F.when(a["out"] == "", "").when(a["n"] == 0, "\n\n").otherwise(" "), s),
            F.when((a["n"] + 1 >= paragraph) | turn(s), 0).otherwise(a["n"] + 1),
        ),
        lambda a: a["out"],
    )


def located(text: Column, span: Column) -> Column:
    """0-based place of a span in a text without case; null if it isn't there."""
    at = F.position(F.lower(span), F.lower(text))
    return F.when(at > 0, at - 1)


def annotate(passages: DataFrame, text: str, language: str, keywords: dict[str, list[str]], annotator) -> DataFrame:
    """Relevant passages through the annotator, the rest with no frames; the gate comes before the model."""
    from .filters import relevance

    gate = relevance(text, language, keywords)
    zero = F.lit(None).cast("map<string,double>")
    return passages.filter(gate).withColumn("probabilities", annotator(F.col(text))).unionByName(passages.filter(~gate).withColumn("probabilities", zero))
