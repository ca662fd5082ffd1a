"""Frames to documents, periods, domains and corpora, and their series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import period
from ..operators import frames, rollup
from .base import CHUNKS, KEYS, OCCURRING, SCORES, WEIGHTED, WHOLE_WEIGHTED, chunks, documents, occurring, query, rounded, scores, weighted

ROUNDED = "round(value, 6) as value, cast(document_count as bigint) as document_count"


def aggregate_sql(by: str, source: str = "weighted", keep: bool = False, how: str = "avg", weight: bool = True) -> str:
    """by: expressions with names, comma-separated."""
    w = "(case when total_weight > 0 then total_weight else 1 end)" if weight else "1.0"
    over = f"sum({w})" if how == "avg" else f"avg({w})"
    names = ", ".join(x.split(" as ")[-1].strip() for x in by.split(";"))
    keys = by.replace(";", ",")
    where = "" if keep else "where any_value"
    cte = WEIGHTED if source == "weighted" else OCCURRING
    return f"""with {cte}, g as (select {keys}, frame, sum(value * {w}) / {over} as value, count(*) as document_count from {source} {where} group by all)
select {names}, frame, {ROUNDED} from g where {' and '.join(f'{n.strip()} is not null' for n in names.split(','))}"""


@query(f"with {CHUNKS} select doc_id, cast(chunk_id as bigint) as chunk_id, chunk from chunks")
def i01_sentence_chunks(spark, d):
    return chunks(spark, d).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "chunk")


@query(f"with {SCORES} select doc_id, cast(chunk_id as bigint) as chunk_id, frame, round(p, 6) as p, cast(w as bigint) as w from scores")
def j16_lexical_annotation(spark, d):
    return rounded(scores(spark, d), "p").select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "frame", "p", F.col("w").cast("long").alias("w"))


@query(f"with {WEIGHTED} select doc_id, corpus, published_at, frame, round(value, 9) as value, total_weight from weighted")
def d01_weighted_documents(spark, d):
    return rounded(weighted(spark, d), "value", digits=9).select("doc_id", "corpus", "published_at", "frame", "value", "total_weight")


@query(f"with {OCCURRING} select doc_id, frame, value, total_weight from occurring")
def d02_occurring_documents(spark, d):
    return occurring(spark, d).select("doc_id", "frame", "value", "total_weight")


def _temporal(unit):
    return lambda df: df.withColumn("period_id", period(F.to_date("published_at"), unit))


TRUNC = {"day": "published_at", "week": "strftime(date_trunc('week', cast(published_at as date)), '%Y-%m-%d')", "month": "strftime(date_trunc('month', cast(published_at as date)), '%Y-%m-%d')", "year": "substr(published_at, 1, 4)", "all": "'all'"}


def _register_temporal():
    for unit, how, keep, weight in (("day", "avg", False, True), ("week", "avg", False, True), ("month", "avg", False, True), ("year", "sum", False, True), ("all", "avg", True, False)):
        name = f"d03_temporal_{unit}_{how}" + "_unweighted" * (not weight)

        def run(spark, d, unit=unit, how=how, keep=keep, weight=weight):
            return rounded(rollup.aggregate(_temporal(unit)(weighted(spark, d)), ["period_id"], how, keep, weight), "value")

        run.__name__ = name
        query(aggregate_sql(f"{TRUNC[unit]} as period_id", keep=keep, how=how, weight=weight))(run)


_register_temporal()


@query(aggregate_sql("domain"))
def d04_domain_aggregate(spark, d):
    return rounded(rollup.aggregate(weighted(spark, d), ["domain"]), "value")


@query(aggregate_sql("corpus", keep=True))
def d05_corpus_aggregate(spark, d):
    return rounded(rollup.aggregate(weighted(spark, d), ["corpus"], keep_empty=True), "value")


GRID = (("year",), ("domain",), ("corpus",), ())


@query(f"""with {WEIGHTED}, y as (select *, substr(published_at, 1, 4) as year from weighted where any_value),
g as (select case when grouping(year) = 0 then 'year' when grouping(domain) = 0 then 'domain' when grouping(corpus) = 0 then 'corpus' else 'global' end as level,
  year, domain, corpus, frame, sum(value * total_weight) / sum(total_weight) as value, count(*) as document_count
  from y group by grouping sets ((year, frame), (domain, frame), (corpus, frame), (frame)))
select level, year, domain, corpus, frame, {ROUNDED} from g""")
def d06_aggregate_grid(spark, d):
    w = weighted(spark, d).withColumn("year", F.substring("published_at", 1, 4))
    return rounded(rollup.aggregate_grid(w, GRID), "value").select("level", "year", "domain", "corpus", "frame", "value", "document_count")


@query(f"""with {OCCURRING}, y as (select *, substr(published_at, 1, 4) as year from occurring),
g as (select case when grouping(year) = 0 then 'year' when grouping(corpus) = 0 then 'corpus' else 'global' end as level, year, corpus, frame,
  avg(value) as value, count(*) as document_count from y group by grouping sets ((year, frame), (corpus, frame), (frame)))
select level, year, corpus, frame, {ROUNDED} from g""")
def d06_occurrence_grid(spark, d):
    o = occurring(spark, d).withColumn("year", F.substring("published_at", 1, 4))
    return rounded(rollup.aggregate_grid(o, (("year",), ("corpus",), ()), keep_empty=True), "value").select("level", "year", "corpus", "frame", "value", "document_count")


@query(f"""with {CHUNKS.replace("from docs)", "from docs where contains(lower(text), 'sh'))", 1)}, gated as (select doc_id from chunks where contains(lower(chunk), 'tion') group by doc_id)
select corpus, cast(count(distinct doc_id) as bigint) as n_docs, cast(count(*) as bigint) as n_chunks from chunks where doc_id in (select doc_id from gated) group by corpus""")
def d07_keyword_gate(spark, d):
    """Document gate before the chunker, then the any-chunk gate."""
    from ..operators.chunking import sentence_chunks

    docs = documents(spark, d).filter(F.lower("text").contains("sh"))
    c = sentence_chunks(docs, "doc_id", "corpus")
    gate = c.filter(F.lower("chunk").contains("tion")).select("doc_id").distinct()
    return c.join(gate, "doc_id", "left_semi").groupBy("corpus").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"))


@query(f"""with {WHOLE_WEIGHTED}, r as (select doc_id, frame, value, row_number() over (partition by doc_id order by value desc, frame_idx) as rank from weighted where value > 0)
select doc_id, cast(rank as bigint) as rank, frame, round(value, 6) as value from r where rank <= 3""")
def e05_top_frames(spark, d):
    """Each document's three best frames, from sentences of any length."""
    w = frames.weighted_documents(scores(spark, d, most_chars=None), KEYS, 0.2, order="chunk_id")
    return rounded(frames.top_frames(w, ["doc_id"], 3, positive=True, exact=True), "value", binary=True)


@query(f"""with {WEIGHTED}, r as (select doc_id, frame, value, published_at, row_number() over (partition by frame order by value desc, doc_id) as rank from weighted where value > 0)
select frame, cast(rank as bigint) as rank, doc_id, published_at, round(value, 6) as value from r where rank <= 5""")
def e06_top_stories(spark, d):
    from pyspark.sql import Window as W

    w = weighted(spark, d).filter("value > 0").withColumn("rank", F.row_number().over(W.partitionBy("frame").orderBy(frames.settled("value").desc(), "doc_id")).cast("long"))
    return rounded(w.filter("rank <= 5"), "value").select("frame", "rank", "doc_id", "published_at", "value")


@query(rf"""with {SCORES}, r as (select *, row_number() over (partition by frame order by p desc, doc_id, chunk_id) as rank from scores where p > 0)
select frame, cast(rank as bigint) as rank, r.doc_id, r.chunk_id, round(p, 6) as p,
  case when length(chunk) <= 160 then chunk else regexp_replace(substr(chunk, 1, 160), '\s\S*$', '') || '...' end as example
from r join chunks c on c.doc_id = r.doc_id and c.chunk_id = r.chunk_id where rank <= 5""")
def e07_frame_examples(spark, d):
    s = frames.lexical_scores(chunks(spark, d), "doc_id", "chunk_id", "chunk")
    return rounded(frames.examples(s, 5, ["doc_id", "chunk_id"]), "p")


DAILY = """, daily as (select cast(published_at as date) as day, frame, sum(value * total_weight) / sum(total_weight) as value from weighted where any_value group by all),
ends as (select min(day) as a, max(day) as b from daily),
grid as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from ends),
dense as (select g.day, f.frame, coalesce(daily.value, 0) as value from grid g cross join (select distinct frame from daily) f left join daily on daily.day = g.day and daily.frame = f.frame)"""


@query(f"""with {WEIGHTED}{DAILY} select strftime(day, '%Y-%m-%d') as day, frame, round(value, 6) as value,
round(avg(value) over (partition by frame order by day rows between 29 preceding and current row), 6) as rolling from dense""")
def e01_rolling_daily(spark, d):
    w = weighted(spark, d).withColumn("day", F.to_date("published_at"))
    series = rollup.aggregate(w, ["day"])
    dense = rollup.rolling_mean(rollup.dense_days(series, ["frame"], "day", "value"), ["frame"], "day", "value", 30)
    return rounded(dense, "value", "rolling").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "frame", "value", "rolling")


TOTALS = """with n as (select cast(strftime(ts, '%Y-%m-%d') as date) as day, count(*)::double as n from events group by all),
ends as (select min(day) as a, max(day) as b from n), grid as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from ends),
dense as (select grid.day, coalesce(n.n, 0) as n from grid left join n using (day))
select strftime(day, '%Y-%m-%d') as day, n, round(avg(n) over (order by day rows between {k} preceding and current row), 6) as rolling from dense"""


def _totals(spark, d, n):
    from ..sources.tables import table

    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    out = rollup.rolling_mean(rollup.dense_days(days, [], "day", "n"), [], "day", "n", n)
    return rounded(out, "rolling").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "rolling")


@query(TOTALS.format(k=29))
def e02_rolling_documents_per_day(spark, d):
    return _totals(spark, d, 30)


@query("""with n as (select event_type as theme, cast(strftime(ts, '%Y-%m-%d') as date) as day, count(*)::double as n from events where value > 40 group by all),
ends as (select theme, min(day) as a, max(day) as b from n group by theme), grid as (select theme, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from ends),
dense as (select theme, day, coalesce(n.n, 0) as n from grid left join n using (theme, day))
select theme, strftime(day, '%Y-%m-%d') as day, n, round(avg(n) over (partition by theme order by day rows between 6 preceding and current row), 6) as rolling from dense""")
def e03_rolling_theme_counts(spark, d):
    from ..sources.tables import table

    n = table(spark, d, "events").filter("value > 40").groupBy(F.col("event_type").alias("theme"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    out = rollup.rolling_mean(rollup.dense_days(n, ["theme"], "day", "n", own_bounds=True), ["theme"], "day", "n", 7)
    return rounded(out, "rolling").select("theme", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "rolling")


@query("""with n as (select event_type as theme, cast(strftime(ts, '%Y-%m-%d') as date) as day, count(*)::double as n from events group by all),
t as (select day, sum(n) as total from n group by day), ends as (select min(day) as a, max(day) as b from n),
grid as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from ends),
dense as (select f.theme, g.day, coalesce(n.n / t.total, 0) as share from grid g cross join (select distinct theme from n) f left join n on n.day = g.day and n.theme = f.theme left join t on t.day = g.day)
select theme, strftime(day, '%Y-%m-%d') as day, round(greatest(0, least(1, avg(share) over (partition by theme order by day rows between 29 preceding and current row))), 5) as share from dense""")
def e04_rolling_theme_share(spark, d):
    from pyspark.sql import Window as W

    from ..sources.tables import table

    n = table(spark, d, "events").groupBy(F.col("event_type").alias("theme"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("day")))
    out = rollup.rolling_mean(rollup.dense_days(n, ["theme"], "day", "share"), ["theme"], "day", "share", 30)
    return out.select("theme", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "rolling")), 5).alias("share"))


@query(f"""with {WEIGHTED}, top as (select domain from weighted where any_value group by domain order by count(distinct doc_id) desc, domain limit 5),
g as (select domain, substr(published_at, 1, 4) as year, frame, sum(value * total_weight) / sum(total_weight) as value, count(*) as document_count
  from weighted where any_value and domain in (select domain from top) group by all)
select domain, year, frame, {ROUNDED} from g""")
def d34_top_domains_by_year(spark, d):
    w = weighted(spark, d).withColumn("year", F.substring("published_at", 1, 4))
    top = w.filter("any_value").groupBy("domain").agg(F.countDistinct("doc_id").alias("n")).orderBy(F.desc("n"), "domain").limit(5).select("domain")
    return rounded(rollup.aggregate(w.join(F.broadcast(top), "domain", "left_semi"), ["domain", "year"]), "value")


@query(f"""with {OCCURRING} select frame, cast(sum(value) as bigint) as n, round(100 * avg(value), 6) as percent from occurring group by frame""")
def d30_occurrence_share(spark, d):
    o = occurring(spark, d)
    return rounded(o.groupBy("frame").agg(F.sum("value").cast("long").alias("n"), (100 * F.avg("value")).alias("percent")), "percent")


@query(f"""with {OCCURRING} select substr(published_at, 1, 4) as year, frame, round(100 * avg(value), 6) as percent, cast(count(*) as bigint) as n_docs
from occurring where published_at <= '2024-06-30' group by all""")
def d31_occurrence_share_by_year(spark, d):
    o = occurring(spark, d).filter("published_at <= '2024-06-30'")
    return rounded(o.groupBy(F.substring("published_at", 1, 4).alias("year"), "frame").agg((100 * F.avg("value")).alias("percent"), F.count("*").alias("n_docs")), "percent")


@query("""with h as (select *, least(cast(floor(p * 5) as integer), 4) as bin from ({0}))
select frame, cast(bin as bigint) as bin, cast(count(*) as bigint) as n from h group by all""".format(f"with {SCORES} select * from scores"))
def d27_probability_histogram(spark, d):
    s = scores(spark, d).withColumn("bin", F.least(F.floor(F.col("p") * 5), F.lit(4)).cast("long"))
    return s.groupBy("frame", "bin").agg(F.count("*").alias("n"))


@query(f"""with {SCORES}, h as (select frame, count_if(p >= 0.3) as n, count(*) as total from scores group by frame)
select frame, cast(n as bigint) as n, round(100.0 * n / sum(n) over (), 6) as percent from h""")
def d28_share_of_hits(spark, d):
    h = scores(spark, d).groupBy("frame").agg(F.count_if(F.col("p") >= 0.3).alias("n"))
    return rounded(h.withColumn("percent", rollup.percent_of(F.col("n"))), "percent")


@query(f"""with {SCORES}, h as (select substr(published_at, 1, 4) as year, frame, count_if(p >= 0.3) as n from scores group by all)
select year, frame, cast(n as bigint) as n, round(100.0 * n / sum(n) over (partition by year), 6) as percent from h""")
def d29_share_of_hits_by_year(spark, d):
    h = scores(spark, d).groupBy(F.substring("published_at", 1, 4).alias("year"), "frame").agg(F.count_if(F.col("p") >= 0.3).alias("n"))
    return rounded(h.withColumn("percent", rollup.percent_of(F.col("n"), "year")), "percent")


@query(f"""with {SCORES}, r as (select doc_id, chunk_id, frame, row_number() over (partition by doc_id, chunk_id order by p desc, frame_idx) as k from scores where p > 0)
select f.frame, cast(count(r.frame) as bigint) as n from (select distinct frame from scores) f left join r on r.frame = f.frame and k <= 2 group by f.frame""")
def d26_frame_coverage(spark, d):
    s = scores(spark, d)
    top = frames.top_frames(s.withColumnRenamed("p", "value"), ["doc_id", "chunk_id"], 2, positive=True)
    names = spark.createDataFrame([(f,) for f in frames.LEXICON], "frame string")
    return names.join(top.groupBy("frame").agg(F.count("*").alias("n")), "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""with {WEIGHTED}, y as (select substr(published_at, 1, 4) as year, frame, sum(value * total_weight) / sum(total_weight) as v from weighted where any_value group by all)
select frame, round(avg(v), 6) as mean_score, cast(row_number() over (order by avg(v) desc, frame) as bigint) as place from y group by frame""")
def d33_frame_order(spark, d):
    from pyspark.sql import Window as W

    y = rollup.aggregate(weighted(spark, d).withColumn("year", F.substring("published_at", 1, 4)), ["year"])
    m = y.groupBy("frame").agg(F.avg("value").alias("mean_score"))  # a row per frame
    return rounded(m.withColumn("place", F.row_number().over(W.orderBy(F.desc("mean_score"), "frame")).cast("long")), "mean_score")


@query(f"""with {WEIGHTED} select year, cast(count(*) as bigint) as n_docs, cast(count(distinct domain) as bigint) as n_domains
from (select distinct doc_id, domain, substr(published_at, 1, 4) as year from weighted) group by year""")
def d42_browser_facets(spark, d):
    w = weighted(spark, d).select("doc_id", "domain", F.substring("published_at", 1, 4).alias("year")).distinct()
    return w.groupBy("year").agg(F.count("*").alias("n_docs"), F.countDistinct("domain").alias("n_domains"))


@query("""select strftime(ts, '%Y-%m-%d') as day, cast(count(*) as bigint) as n from events where ts < timestamp '2024-01-20' group by all""")
def d32_documents_per_day(spark, d):
    from ..sources.tables import table

    e = table(spark, d, "events").filter("ts < timestamp '2024-01-20'")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"""with {WEIGHTED}, g as (select corpus, strftime(date_trunc('month', cast(published_at as date)), '%Y-%m-%d') as period_id, frame,
sum(value * total_weight) / sum(total_weight) as value, count(*) as document_count from weighted where any_value group by all)
select corpus, period_id, frame, {ROUNDED} from g""")
def flagship_monthly_frames(spark, d):
    """Sentences, lexical scores, weighted documents, and months by corpus."""
    w = weighted(spark, d).withColumn("period_id", period(F.to_date("published_at"), "month"))
    return rounded(rollup.aggregate(w, ["corpus", "period_id"]), "value")
