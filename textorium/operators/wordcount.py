"""Themed keyword counts: documents, days, domains and co-occurrence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_count, text_of


def theme_of(themes: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Keyword to theme; a keyword of several themes goes to the last."""
    return {k: t for t, ks in themes.items() for k in ks}


def one_pass(keywords: Sequence[str], modes: Mapping) -> bool:
    """Whole words of letters, taken as they stand: no hit of one is part of another's, so that one pattern finds all."""
    return all(k.isascii() and k.isalpha() for k in keywords) and modes.get("whole_word", True) and not modes.get("hyphenation", True) and not modes.get("case_sensitive", False)


def _found(docs: DataFrame, keywords: Sequence[str], keep: Sequence[str], text: str) -> DataFrame:
    """(keep, _f): the keywords of each text, in small letters, as often as they occur. The explode of one row keeps later columns from being folded in."""
    pattern = rf"(?iU)\b({'|'.join(sorted(set(keywords)))})\b"
    return docs.select(*keep, F.explode(F.array(F.transform(F.regexp_extract_all(text_of(text), F.lit(pattern), 1), F.lower))).alias("_f")).filter(F.size("_f") > 0)


def keyword_rows(docs: DataFrame, keywords: Sequence[str], *keep: str, text: str = "text", **modes) -> DataFrame:
    """(keep, keyword, n): counts over 0, one pass over the text for all keywords."""
    if keywords and one_pass(keywords, modes):
        same = {k.lower() for k in keywords}
        n = lambda k: F.size(F.filter("_f", lambda x: x == k.lower())).cast("long")
        docs, counts = _found(docs, list(same), keep, text), [(k, n(k)) for k in keywords]
    else:
        counts = [(k, keyword_count(text, k, **modes)) for k in keywords]
    pairs = F.array(*(F.struct(F.lit(k).alias("keyword"), n.alias("n")) for k, n in counts))
    return docs.select(*keep, F.explode(F.filter(pairs, lambda x: x["n"] > 0)).alias("x")).select(*keep, "x.keyword", "x.n")


def presence(docs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(keyword, n_docs, percent): documents that have a keyword, of all documents."""
    total = docs.agg(F.count("*").alias("total"))  # one row
    n = rows.groupBy("keyword").agg(F.countDistinct(key).alias("n_docs"))
    return n.join(F.broadcast(total)).select("keyword", "n_docs", (100 * F.col("n_docs") / F.col("total")).alias("percent"))


def theme_hits(docs: DataFrame, themes: Mapping[str, Sequence[str]], *keep: str, text: str = "text", **modes) -> DataFrame:
    """(keep, theme, hits) of each document that has any of a theme's keywords; no shuffle."""
    owner = theme_of(themes)
    sums, single = [], one_pass(list(owner), modes) and bool(owner)
    if single:
        docs = _found(docs, [k.lower() for k in owner], keep, text)
    for t in themes:
        ks = [k for k, o in owner.items() if o == t]
        if ks and single:
            own = [k.lower() for k in ks]
            sums.append(F.struct(F.lit(t).alias("theme"), F.size(F.filter("_f", lambda x: x.isin(own))).cast("long").alias("hits")))  # noqa: B023
        elif ks:
            total = sum((keyword_count(text, k, **modes) for k in ks), F.lit(0).cast("long"))
            sums.append(F.struct(F.lit(t).alias("theme"), total.alias("hits")))
    return docs.select(*keep, F.explode(F.filter(F.array(*sums), lambda x: x["hits"] > 0)).alias("x")).select(*keep, "x.theme", "x.hits")


def theme_counts(hits: DataFrame, by: Sequence[str] = (), min_hits: int = 1) -> DataFrame:
    """(by, theme, n_docs) over documents with min_hits of a theme at least."""
    return hits.filter(F.col("hits") >= min_hits).groupBy(*by, "theme").agg(F.count("*").alias("n_docs"))


def domain_counts(hits: DataFrame, key: str, domain: str) -> DataFrame:
    """(domain, n_docs): documents with any hit at all."""
    return hits.groupBy(domain).agg(F.countDistinct(key).alias("n_docs"))


def cooccurrence(hits: DataFrame, key: str, min_hits: int = 1) -> DataFrame:
    """(a, b, n_docs): ordered pairs of themes of the same document, equal ones included.

    A document's themes, at most as many as there are themes, meet in one array; pairs are counted before the shuffle.
    """
    per = hits.filter(F.col("hits") >= min_hits).groupBy(key).agg(F.collect_set("theme").alias("ts"))
    return per.select(F.explode("ts").alias("a"), "ts").select("a", F.explode("ts").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n_docs"))
