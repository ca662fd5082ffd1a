"""Operator 1: hierarchical empirical Bayes quality classifier.

A document's own evidence is a naive Bayes score over binned text measures, whose likelihood ratios come from grouped
counts over the labelled documents. Documents then speak for their host and for their path on that host: labels
where there are any, the document score elsewhere. A host's posterior is shrunk towards the corpus, a path's
towards its host, each by a beta prior whose weight is fitted to the spread of that level by moments. A document's own
say is taken out of its site's posteriors, so that it counts once, and the excess of its path's posterior over the
corpus is added to the document's log odds: the sum is the posterior log odds of the hierarchy.

Cases: a null text is measured as an empty one; null hosts and paths are groups of their own; several labels of a
document are averaged, null labels ignored; without labels of both kinds the document evidence is neutral and
every document is kept; repeated rows are scored each; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, words, written

BINS = 10


def _log_bin(x: Column, scale: float) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.log2(1 + x * scale)).cast("int"))


def _even_bin(x: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(x * BINS).cast("int"))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """keep and `bins`, an array with the bin of each measure."""
    d = as_rows(docs, *keep, "text").withColumn("_t", F.coalesce("text", F.lit(""))).drop("text")
    d = d.withColumn("_w", words("_t")).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x != ""))
    d = d.withColumn("_n", F.greatest(F.lit(1), F.size("_w"))).withColumn("_chars", F.greatest(F.lit(1), F.length("_t")))
    d = d.withColumn("_letters", F.regexp_replace("_t", r"[^\p{L}]+", ""))
    letters = F.greatest(F.lit(1), F.length("_letters"))
    upper = F.length(F.regexp_replace("_letters", r"[^\p{Lu}]+", ""))
    marks = F.length("_t") - F.length(F.translate("_t", "#*$%&|<>!~^=_{}[]", ""))
    lines = F.greatest(F.lit(1), F.size("_lines"))
    bins = F.array(
        _log_bin(F.size("_w"), 0.125),
        _even_bin(F.size(F.array_distinct("_w")) / F.col("_n")),
        _log_bin(F.length("_t") / F.col("_n"), 4.0),
        _log_bin(marks / F.col("_n"), 16.0),
        _even_bin(upper / letters),
        _even_bin(F.length("_letters") / F.col("_chars")),
        _even_bin(F.size(F.array_distinct("_lines")) / lines),
    )
    return d.select(*keep, bins.alias("bins"))


def _ratios(labelled: DataFrame) -> tuple[float, list[list[float]]]:
    """Prior log odds and, for each measure, the log likelihood ratio of its bins.

    The table that comes to the driver has a row per (measure, bin), 7 x BINS at most, whatever the input.
    """
    counts = labelled.select("y", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    total = labelled.agg(F.sum("y"), F.count("*")).first()
    good, n = float(total[0] or 0), float(total[1] or 0)
    wide = 1 + max((r["f"] for r in counts), default=0)
    out = [[0.0] * BINS for _ in range(wide)]
    if good <= 0 or good >= n:
        return math.inf, out
    for r in counts:
        g, b = float(r["good"]), float(r["n"] - r["good"])
        # one pseudo-document of each class, spread by the pooled share of the bin
        pool = r["n"] / n
        out[r["f"]][r["b"]] = math.log((g + 4 * pool) / (good + 4)) - math.log((b + 4 * pool) / (n - good + 4))
    return math.log(good / (n - good)), out


def _shrunk(groups: DataFrame, keys: list[str], mean: Column) -> Column:
    """Beta weight by moments of a level with sums `y` and counts `n` around `mean`; a Column over its one-row total."""
    chance = F.sum(mean * (1 - mean) * F.col("n")) / F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col("y") / F.col("n") - mean, 2)) / F.sum("n") - chance * F.count("*") / F.sum("n")
    return F.when((chance > 0) & (spread > 0), F.greatest(F.lit(1.0), F.least(F.lit(1e6), chance / spread - 1))).otherwise(1e6)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host: str = "source", path: str = "lang",
             label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(id, doc_score, host_score, path_score, score, kept), a row per row of docs.

    Scores are probabilities of good quality: of the document's own evidence, the host's and the path's posterior
    means without the document itself, and all together.
    """
    feats = written(features(docs.select(F.col(id_col).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), "text"), "id", "host", "path"), "features")
    y = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.avg(label).alias("y"))
    feats = written(feats.join(y, feats["id"] == y["lid"], "left").drop("lid"), "labelled")
    prior, ratios = _ratios(feats.filter("y is not null"))
    known = math.isfinite(prior)
    odds = F.lit(prior if known else 0.0)
    if known:
        for f, row in enumerate(ratios):
            odds = odds + F.element_at(F.array(*map(F.lit, row)), F.col("bins")[f] + 1)
    logit = lambda p: F.log(p) - F.log(1 - p)
    scored = feats.withColumn("odds", odds if known else F.lit(20.0)).withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    says = scored.withColumn("v", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.coalesce("y", "p"))))

    paths = written(says.groupBy("host", "path").agg(F.sum("v").alias("y"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    corpus = F.broadcast(hosts.agg((F.sum("y") / F.sum("n")).alias("mean")))  # one row
    at = hosts.join(corpus)
    weight = F.broadcast(at.agg(_shrunk(at, ["host"], F.col("mean")).alias("w")))  # one row
    posterior = lambda y, n, prior, w: (y + prior * w) / (n + w)
    hosts = at.join(weight).select(
        F.col("host").alias("h"), "mean", F.col("w").alias("w_host"), F.col("y").alias("y_host"), F.col("n").alias("n_host"),
        posterior(F.col("y"), F.col("n"), F.col("mean"), F.col("w")).alias("m_host"),
    )
    at = paths.join(hosts, paths["host"].eqNullSafe(hosts["h"]))
    weight = F.broadcast(at.agg(_shrunk(at, ["host", "path"], F.col("m_host")).alias("w_path")))  # one row
    sites = at.join(weight).select("h", F.col("path").alias("q"), "mean", "w_host", "y_host", "n_host", "w_path", F.col("y").alias("y_path"), F.col("n").alias("n_path"))

    d = says.join(sites, says["host"].eqNullSafe(sites["h"]) & says["path"].eqNullSafe(sites["q"]))
    d = d.withColumn("host_score", posterior(F.col("y_host") - F.col("v"), F.col("n_host") - 1, F.col("mean"), F.col("w_host")))
    d = d.withColumn("path_score", posterior(F.col("y_path") - F.col("v"), F.col("n_path") - 1, F.col("host_score"), F.col("w_path")))
    score = 1 / (1 + F.exp(-(F.col("odds") + logit(F.col("path_score")) - logit(F.col("mean")))))
    return d.select(
        F.col("id").alias(id_col), F.col("p").alias("doc_score"), "host_score", "path_score", score.alias("score"), (score >= threshold).alias("kept")
    )
