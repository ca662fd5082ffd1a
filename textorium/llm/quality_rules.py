"""Operator 2: document rules with host-level verdicts.

Each document gets text measures and a base verdict; failures are counted by host, every host's failure rate is
shrunk towards the corpus rate by a beta prior fitted to the hosts themselves. A host fails if its posterior mean, less
`sure` posterior standard deviations, is still over `times` the corpus rate; it then takes its documents with it. Small
hosts and hosts that differ by chance never do. Everything is DataFrame expressions.

Cases: a null text has no words and fails; a null host is a host of its own; repeated rows count each time; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_rows, words, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, the measures and base_failed, a row per document; no shuffle."""
    d = as_rows(docs, *keep, "text").withColumn("_text", F.coalesce("text", F.lit(""))).drop("text")
    d = d.withColumn("_w", words("_text")).withColumn("n_words", F.size("_w").cast("long"))
    has_word = r"[^\x20\x09-\x0D]"
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(has_word)))
    d = d.withColumn("word_chars", F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    none = "cast(array() as array<bigint>)"
    d = d.withColumn(
        "_h",
        F.expr(f"if(n_words >= {WINDOW}, transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64(slice(_w, i + 1, {WINDOW}))), {none})"),
    )
    # Only texts in which some window comes back pay for the sort: equal windows become neighbours.
    d = d.withColumn(
        "_s",
        F.expr(
            f"if(size(array_distinct(_h)) < size(_h), array_sort(transform(_h, (h, i) -> struct(h, slice(_w, i + 1, {WINDOW}) as g, i))),"
            " cast(array() as array<struct<h:bigint,g:array<string>,i:int>>))"
        ),
    )
    same = "(_s[{a}].h = _s[{b}].h and _s[{a}].g = _s[{b}].g)"
    d = d.withColumn(
        "_p",
        F.expr(
            "if(size(_s) > 0, sort_array(transform(filter(sequence(0, size(_s) - 1), k -> "
            f"(k > 0 and {same.format(a='k', b='k - 1')}) or (k < size(_s) - 1 and {same.format(a='k', b='k + 1')})),"
            " k -> _s[k].i)), cast(array() as array<int>))"
        ),
    )
    covered = f"transform(_p, (p, k) -> if(k < size(_p) - 1, least({WINDOW}, _p[k + 1] - p), {WINDOW}))"
    d = d.withColumn("n_repeat_words", F.expr(f"aggregate({covered}, 0L, (a, x) -> a + x)"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.withColumn("base_failed", failed).select(*keep, *MEASURES, "base_failed")


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """(host, n, failed, corpus, rate, spread): the corpus rate, and the beta posterior mean and standard deviation of each host's.

    The prior's mean is the corpus rate and its weight comes from the spread of the hosts' rates by moments: the
    spread that is left after what chance alone would give.
    """
    by_host = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    total = by_host.agg(
        F.sum("n").alias("n_all"), F.sum("failed").alias("f_all"), F.count("*").alias("hosts"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"),
    )
    mean = F.col("f_all") / F.col("n_all")
    chance = mean * (1 - mean)
    spread = (F.col("squares") / F.col("n_all") - mean * mean) - chance * (F.col("hosts") - 1) / F.col("n_all")
    weight = F.when((chance > 0) & (spread > 0), F.greatest(F.lit(1.0), F.least(F.lit(1e6), chance / spread - 1))).otherwise(1e6)
    prior = total.select(mean.alias("prior"), weight.alias("weight"))  # one row
    size = F.col("n") + F.col("weight")
    rates = by_host.join(F.broadcast(prior)).withColumn("rate", (F.col("failed") + F.col("prior") * F.col("weight")) / size)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (size + 1))
    return rates.select("host", "n", "failed", F.col("prior").alias("corpus"), "rate", deviation.alias("spread"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host: str = "source", times: float = 2.0, sure: float = 2.0) -> DataFrame:
    """(id, measures, base_failed, kept, host_failed), a row per row of docs.

    The measures are written once and read for the counts and for the join; the join back is on the host, whose
    large partitions Spark splits at run time.
    """
    m = written(measures(docs, id_col, host), "rules")
    bad = host_rates(m, host).select("host", (F.col("rate") - sure * F.col("spread") > times * F.col("corpus")).alias("host_failed"))
    joined = m.join(bad, m[host].eqNullSafe(bad["host"]), "left")
    failed = F.coalesce("host_failed", F.lit(False))
    return joined.select(id_col, *MEASURES, "base_failed", (~F.col("base_failed") & ~failed).alias("kept"), failed.alias("host_failed"))


SQL = r"""
with base as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from base),
g as (select r, i, list_slice(w, i, i + 7) as g from w, unnest(range(1, len(w) - 6)) u(i)),
dup as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
rep as (select r, count(distinct i + o) as n from dup, unnest(range(0, 8)) v(o) group by r),
lines as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from base),
m as (select base.doc_id, base.source, cast(len(w.w) as bigint) as n_words,
  cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from base join w using (r) join lines using (r) left join rep using (r)),
f as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from m),
h as (select source, count(*) as n, sum(cast(base_failed as bigint)) as failed from f group by source),
tot as (select sum(n) as n_all, sum(failed) / sum(n) as mean, count(*) as hosts, sum(failed * failed / n) as squares from h),
var as (select mean, mean * (1 - mean) as chance,
  (squares / n_all - mean * mean) - mean * (1 - mean) * (hosts - 1) / n_all as spread from tot),
prior as (select mean, case when chance > 0 and spread > 0 then greatest(1.0, least(1e6, chance / spread - 1)) else 1e6 end as weight from var),
post as (select source, mean, n + weight as size, (failed + mean * weight) / (n + weight) as rate from h, prior),
bad as (select source, rate - 2 * sqrt(rate * (1 - rate) / (size + 1)) > 2 * mean as host_failed from post)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and not host_failed) as kept, host_failed
from f join bad on f.source is not distinct from bad.source
"""
