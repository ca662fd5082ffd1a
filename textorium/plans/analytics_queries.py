"""Word counts, report tables, joins, retrieval, matching, metrics, spans, sampling and incremental queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, vectors
from ..operators import actors, dedup, evaluation, filters, incremental, metrics, models, retrieval, rollup, sampling, wordcount
from ..sources import keyed
from ..sources.tables import shared_folder, spread, table
from .base import DOCS, documents, query, rounded

THEMES = {"tone": ("that", "this", "nicht"), "place": ("from", "dans", "with"), "link": ("and", "und", "con")}
TOK = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '')"
_HITS = ", ".join("{'t': '%s', 'n': len(list_filter(t, lambda x: x in (%s)))}" % (t, ", ".join(f"'{w}'" for w in ws)) for t, ws in THEMES.items())
HITS = f"""{DOCS}, tk as (select doc_id, domain, published_at, {TOK} as t from docs),
hits as (select doc_id, domain, published_at, u.h.t as theme, u.h.n as hits from tk, unnest([{_HITS}]) u(h) where u.h.n > 0)"""


def hits(spark, d):
    return wordcount.theme_hits(documents(spark, d), THEMES, "doc_id", "domain", "published_at", hyphenation=False)


@query(f"""with t as (select doc_id, {TOK} as t from documents), k as (select doc_id, u.k as keyword, len(list_filter(t, lambda x: x = u.k)) as n from t, unnest(['that', 'nicht', 'dans']) u(k))
select keyword, cast(count_if(n > 0) as bigint) as n_docs, round(100.0 * count_if(n > 0) / (select count(*) from documents), 6) as percent from k group by keyword""")
def d08_keyword_presence(spark, d):
    t = table(spark, d, "documents")
    rows = wordcount.keyword_rows(t, ["that", "nicht", "dans"], "doc_id", hyphenation=False)
    return rounded(wordcount.presence(t, rows, "doc_id"), "percent")


@query(f"with {HITS} select theme, published_at, cast(count(*) as bigint) as n_docs from hits where hits >= 3 group by all")
def d12_theme_days(spark, d):
    return wordcount.theme_counts(hits(spark, d), ["published_at"], 3)


@query(f"with {HITS} select domain, cast(count(distinct doc_id) as bigint) as n_docs from hits group by domain")
def d12_theme_domains(spark, d):
    return wordcount.domain_counts(hits(spark, d), "doc_id", "domain")


@query(f"with {HITS} select doc_id, theme, cast(case when hits >= 3 then 1 else 0 end as double) as value from hits")
def d13_theme_documents(spark, d):
    return hits(spark, d).select("doc_id", "theme", F.when(F.col("hits") >= 3, 1.0).otherwise(0.0).alias("value"))


@query(f"with {HITS} select a.theme as a, b.theme as b, cast(count(*) as bigint) as n_docs from hits a join hits b using (doc_id) where a.hits >= 2 and b.hits >= 2 group by all")
def c19_theme_cooccurrence(spark, d):
    return wordcount.cooccurrence(hits(spark, d), "doc_id", 2)


@query(f"""with {HITS}, g as (select a.theme as a, b.theme as b, count(*) as n from hits a join hits b using (doc_id) group by all)
select x.theme as a, y.theme as b, round(coalesce(100.0 * g.n / (select count(*) from documents), 0), 6) as percent
from (select distinct theme from hits) x cross join (select distinct theme from hits) y left join g on g.a = x.theme and g.b = y.theme""")
def d45_cooccurrence_percent(spark, d):
    n = table(spark, d, "documents").agg(F.count("*").alias("total"))  # one row
    grid = spark.createDataFrame([(a, b) for a in THEMES for b in THEMES], "a string, b string")
    c = grid.join(wordcount.cooccurrence(hits(spark, d), "doc_id"), ["a", "b"], "left").join(F.broadcast(n))
    return rounded(c.select("a", "b", F.coalesce(100 * F.col("n_docs") / F.col("total"), F.lit(0.0)).alias("percent")), "percent")


@query(f"""with {HITS}, r as (select theme, doc_id, hits, published_at, row_number() over (partition by theme order by hits desc, published_at desc, doc_id) as rank from hits)
select theme, cast(rank as bigint) as rank, doc_id, cast(hits as bigint) as hits, published_at from r where rank <= 10""")
def e08_top_documents_per_theme(spark, d):
    r = retrieval.first_n(hits(spark, d), ["theme"], [F.desc("hits"), F.desc("published_at"), "doc_id"], 10)
    return r.select("theme", F.col("rank").cast("long").alias("rank"), "doc_id", "hits", "published_at")


@query("select lang, arg_max(theme, ord) as theme from (values ('en', 'a', 1), ('fr', 'b', 2), ('en', 'c', 3)) t(lang, theme, ord) join (select distinct lang from documents) using (lang) group by lang")
def c06_keyword_theme_last_wins(spark, d):
    m = spark.createDataFrame([("en", "a", 1), ("fr", "b", 2), ("en", "c", 3)], "lang string, theme string, ord int")
    return table(spark, d, "documents").select("lang").distinct().join(F.broadcast(dedup.last_by(m, ["lang"], "ord")), "lang").select("lang", "theme")


# Reports by country and party: nations and customers stand in.
NATION = "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def _customers(spark, d):
    n = F.broadcast(table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))


@query(f"select n_name as country, r_name as family, round(avg(c_acctbal), 6) as mean_score, round(sum(c_acctbal), 4) as sum_score, cast(count(*) as bigint) as n from {NATION} group by all")
def c04_d22_country_aggregate(spark, d):
    g = _customers(spark, d).groupBy(F.col("n_name").alias("country"), F.col("r_name").alias("family")).agg(F.avg("c_acctbal").alias("mean_score"), F.sum("c_acctbal").alias("sum_score"), F.count("*").alias("n"))
    return rounded(rounded(g, "mean_score"), "sum_score", digits=4)


@query(f"""with g as (select n_name as country, c_mktsegment as frame, sum(c_acctbal * (1 + c_custkey % 3)) / sum(1 + c_custkey % 3) as v from {NATION} where c_mktsegment <> 'MACHINERY' group by all)
select country, arg_max(frame, v) as frame, round(max(v), 6) as value from g where v <> 0 group by country""")
def d23_dominant_frame(spark, d):
    w = 1 + F.col("c_custkey") % 3
    g = _customers(spark, d).filter("c_mktsegment <> 'MACHINERY'").groupBy(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("frame")).agg((F.sum(F.col("c_acctbal") * w) / F.sum(w)).alias("v"))
    return rounded(g.filter("v <> 0").groupBy("country").agg(F.max_by("frame", "v").alias("frame"), F.max("v").alias("value")), "value")


@query("""with o as (select l_orderkey, sum(l_extendedprice * l_quantity) / sum(l_quantity) as v from lineitem group by l_orderkey),
p as (select n_name as country, c_custkey as party, sum(v) as score from o join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by all),
r as (select *, row_number() over (partition by country order by score desc, party) as rank from p where score > 0)
select country, party, round(score, 4) as score, cast(rank as bigint) as rank from r where rank <= 3""")
def c05_d24_f09_party_scores(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity")).alias("v"))
    o = o.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = o.join(_customers(spark, d), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("country"), F.col("c_custkey").alias("party")).agg(F.sum("v").alias("score"))
    r = retrieval.first_n(p.filter("score > 0"), ["country"], [F.desc("score"), "party"], 3)
    return rounded(r.withColumn("rank", F.col("rank").cast("long")), "score", digits=4)


@query("""select c_mktsegment as hypothesis, round(max(case when c_custkey % 2 = 0 then c_acctbal else -c_acctbal end), 6) as entails, round(max(case when c_custkey % 2 = 0 then -c_acctbal else c_acctbal end), 6) as contradicts,
round(avg(c_acctbal), 6) as neutral from customer group by all""")
def d25_hypothesis_aggregate(spark, d):
    c = table(spark, d, "customer")
    pro = F.col("c_custkey") % 2 == 0
    a, n = F.col("c_acctbal"), -F.col("c_acctbal")
    g = c.groupBy(F.col("c_mktsegment").alias("hypothesis")).agg(F.max(F.when(pro, a).otherwise(n)).alias("entails"), F.max(F.when(pro, n).otherwise(a)).alias("contradicts"), F.avg(a).alias("neutral"))
    return rounded(g, "entails", "contradicts", "neutral")


@query("select documents.doc_id, coalesce(quality, 0) as score from documents left join labels using (doc_id)")
def c02_left_join_default(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("score"))


@query("select lang, cast(sum(quality) as bigint) as good, cast(count(*) as bigint) as n from documents join labels using (doc_id) group by lang")
def c03_inner_join(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))


@query("select doc_id, coalesce(nullif(trim(source), ''), lang, 'none') as place from documents")
def c01_first_source_wins(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.trim("source"), F.lit("")), "lang", F.lit("none")).alias("place"))


@query("""select o.o_orderkey, coalesce(c.c_name, '') as title from orders o left join (select * from customer where c_acctbal >= 0) c on c_custkey = o_custkey""")
def c07_c18_left_join_coalesce(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").filter("c_acctbal >= 0")  # debtors' orders have no title
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("title"))


@query("select conv_id || '_' || turn as finding, cast(conv_id as varchar) as doc from conversations")
def c08_finding_document(spark, d):
    f = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    return table(spark, d, "conversations").select(f.alias("finding"), ids.finding_document(f).alias("doc"))


COS = "list_cosine_similarity(q.embedding::double[], v.embedding::double[])"
TOPK = f"""with s as (select q.vec_id as query_id, v.vec_id, v.label, {COS} as score from embeddings q, embeddings v where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)"""


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(TOPK + " select query_id, vec_id, round(score, 6) as score, cast(rank as bigint) as rank from r where rank <= 10")
def c09_e09_j04_exact_top_k(spark, d):
    t = retrieval.top_k(_queries(spark, d), table(spark, d, "embeddings"), 10)
    return rounded(t.withColumn("rank", F.col("rank").cast("long")), "score")


@query(TOPK + """, e as (select query_id, vec_id, label, score, case when score > 0.25 then 'entailment' when -score > 0.2 then 'contradiction' else 'neutral' end as class from r where rank <= 200 and score >= 0.1)
select label as media, cast(count(*) as bigint) as total, cast(count_if(class = 'entailment') as bigint) as entailment, cast(count_if(class = 'neutral') as bigint) as neutral, cast(count_if(class = 'contradiction') as bigint) as contradiction from e group by label""")
def d10_j11_b21_claim_support(spark, d):
    e = table(spark, d, "embeddings")
    r = retrieval.top_k(_queries(spark, d), e, 200).filter("score >= 0.1").join(e.select("vec_id", "label"), "vec_id")
    r = r.withColumn("class", F.when(F.col("score") > 0.25, "entailment").when(-F.col("score") > 0.2, "contradiction").otherwise("neutral"))
    n = lambda k: F.count_if(F.col("class") == k).alias(k)
    return r.groupBy(F.col("label").alias("media")).agg(F.count("*").alias("total"), n("entailment"), n("neutral"), n("contradiction"))


@query(TOPK + """, one as (select *, 0.3 * 0.5 + 0.7 * score as s1 from r where rank <= 100), k as (select *, row_number() over (partition by query_id order by s1 desc, vec_id) as r1 from one),
two as (select *, score * (1 + label / 10.0) as s2 from k where r1 <= 10)
select query_id, vec_id, round(s1, 6) as stage1, round(s2, 6) as stage2, cast(row_number() over (partition by query_id order by s2 desc, vec_id) as bigint) as rank2 from two""")
def j10_h34_two_stage_matching(spark, d):
    e = table(spark, d, "embeddings")
    c = retrieval.top_k(_queries(spark, d), e, 100).join(e.select("vec_id", "label"), "vec_id")
    first = retrieval.ensemble([(0.3, F.lit(0.5)), (0.7, F.col("score"))])
    r = retrieval.two_stage(c, "query_id", "vec_id", first, F.col("score") * (1 + F.col("label") / 10.0), 10)
    return rounded(r.select("query_id", "vec_id", "stage1", "stage2", F.col("rank2").cast("long").alias("rank2")), "stage1", "stage2")


@query("""with first as (select user_id as vec_id, arg_min(value, event_id) as score from events group by user_id)
select vec_id, round(coalesce(score, 0), 6) as score from embeddings left join first using (vec_id)""")
def c20_realigned_scores(spark, d):
    given = table(spark, d, "events").select(F.col("user_id").alias("vec_id"), F.col("value").alias("score"), "event_id")
    return rounded(retrieval.realigned(table(spark, d, "embeddings").select("vec_id"), given, "vec_id", "score", "event_id"), "score")


@query("""with s as (select source, lang, list(distinct label) as found from (select source, lang, case when quality = 1 then 'good' else 'poor' end as label from documents join labels using (doc_id)
  union all select source, lang, case when toxic = 1 then 'toxic' else 'mild' end from documents join labels using (doc_id)) group by source, lang)
select source, array_to_string(list_sort(list_distinct(flatten(list(found)))), ',') as keywords from s group by source""")
def g07_keyword_union(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    said = F.array(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic").otherwise("mild"))
    by_lang = t.select("source", "lang", F.explode(said).alias("k")).groupBy("source", "lang").agg(F.collect_set("k").alias("found"))
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))
    return by_lang.groupBy("source").agg(F.array_join(union, ",").alias("keywords"))


@query(f"""with s as (select v.vec_id, {COS} as c from embeddings q, embeddings v where q.vec_id < 4) select vec_id, cast(count_if(c >= 0.2) as bigint) as above, round(max(c), 6) as best from s group by vec_id""")
def j07_reference_similarity(spark, d):
    e = table(spark, d, "embeddings")
    refs = F.broadcast(e.filter("vec_id < 4").agg(F.collect_list("embedding").alias("refs")))  # four vectors
    s = e.join(refs).withColumn("cs", F.transform("refs", lambda r: vectors.cosine(F.col("embedding"), r)))
    return rounded(s.select("vec_id", F.size(F.filter("cs", lambda c: c >= 0.2)).cast("long").alias("above"), F.array_max("cs").alias("best")), "best")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 6) as norm, cast(len(embedding) as bigint) as dims from embeddings")
def h28_h29_norms(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(e.select("vec_id", vectors.norm(F.col("embedding")).alias("norm"), F.size("embedding").cast("long").alias("dims")), "norm")


@query("select event_id, round(1 / (1 + exp(-value / 50)), 6) as sig, round(greatest(0, least(1, value / 100)), 6) as clamp, case when value / 100 > 0.7 then 'entailment' when 1 - value / 100 > 0.7 then 'contradiction' else 'neutral' end as class from events")
def h27_h30_h33_scores(spark, d):
    e = table(spark, d, "events")
    v = F.col("value")
    return rounded(e.select("event_id", vectors.sigmoid(v / 50).alias("sig"), vectors.clamped(v / 100).alias("clamp"), vectors.support_class(v / 100, 1 - v / 100).alias("class")), "sig", "clamp")


@query("select event_id, round(case when max(value) over w > min(value) over w then (value - min(value) over w) / (max(value) over w - min(value) over w) else 0.5 end, 6) as scaled from events window w as (partition by user_id)")
def h31_min_max(spark, d):
    return rounded(table(spark, d, "events").select("event_id", retrieval.min_max(F.col("value"), "user_id").alias("scaled")), "scaled")


@query("""select conv_id, turn, case when contains(lower(text), 'thank') then 'thank' when contains(lower(text), 'the') then 'the' end as label,
cast(case when contains(lower(text), 'thank') or contains(lower(text), 'the') then 0.1 else 0.0 end as double) as score from conversations
union all select doc_id, -1, case when toxic = 1 then 'toxic' else 'mild' end, least(1.0, greatest(0.0, quality * 1.7 - 0.2))::double from labels""")
def h37_label_parse(spark, d):
    """Answers in words (conversations) and in JSON, with scores beyond 0 and 1 (labels)."""
    said = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("answer"))
    label = F.when(F.col("toxic") == 1, "toxic").otherwise("mild")
    structured = F.to_json(F.struct(label.alias("label"), (F.col("quality") * 1.7 - 0.2).alias("confidence")))
    both = said.unionByName(table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), F.lit(-1).alias("turn"), structured.alias("answer")))
    p = vectors.parsed_label(F.col("answer"), ["thank", "the"])
    return both.select("conv_id", "turn", p["label"].alias("label"), p["score"].alias("score"))


@query("""select doc_id, cast(2.0 * quality - toxic as double) as utility, quality between 0 and 1 and toxic between 0 and 1 as valid, case when toxic >= quality then 'toxic' else 'quality' end as best from labels""")
def h25_h32_h35_d18_maps(spark, d):
    m = table(spark, d, "labels").select("doc_id", F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double")).alias("m"))
    best = F.when(F.col("m")["toxic"] >= F.col("m")["quality"], "toxic").otherwise("quality")
    return m.select("doc_id", vectors.utility(F.col("m"), {"quality": 2.0, "toxic": -1.0}).alias("utility"), vectors.valid_output(F.col("m"), ["quality", "toxic"]).alias("valid"), best.alias("best"))


PAIRS = "pairs as (select cast(quality as varchar) as gold, cast(1 - toxic as varchar) as predicted from labels)"


def _pairs(spark, d):
    return table(spark, d, "labels").select(F.col("quality").cast("string").alias("gold"), (1 - F.col("toxic")).cast("string").alias("predicted"))


@query(f"with {PAIRS} select round(avg(cast(gold = predicted as integer)), 6) as accuracy from pairs")
def d15_accuracy(spark, d):
    return rounded(metrics.accuracy(_pairs(spark, d)), "accuracy")


CLASSES = f"""{PAIRS}, l as (select distinct gold as label from pairs union select distinct predicted from pairs),
c as (select label, count_if(gold = label and predicted = label) as tp, count_if(gold <> label and predicted = label) as fp, count_if(gold = label and predicted <> label) as fn from l, pairs group by label),
m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from c),
f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1, tp + fn as support from m)"""


@query(f"with {CLASSES} select label, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from f")
def d16_per_class(spark, d):
    return rounded(metrics.per_class(_pairs(spark, d)).select("label", "precision", "recall", "f1", "support"), "precision", "recall", "f1")


@query(f"""with {CLASSES} select round(avg(p), 6) as macro_precision, round(avg(r), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(sum(p * support) / sum(support), 6) as weighted_precision,
round(sum(r * support) / sum(support), 6) as weighted_recall, round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(sum(tp) / sum(support), 6) as micro, round(sum(support) / sum(tp + fp), 6) as micro_ref from f""")
def d16_averages(spark, d):
    a = metrics.averages(metrics.per_class(_pairs(spark, d)))
    return rounded(a, *a.columns)


@query(f"with {PAIRS}, l as (select gold as x from pairs union select predicted from pairs) select g.x as gold, p.x as predicted, cast(count(pairs.gold) as bigint) as n from l g cross join l p left join pairs on gold = g.x and predicted = p.x group by all")
def d17_g06_confusion(spark, d):
    return metrics.confusion(_pairs(spark, d))


@query("""with s as (select lang, quality = 1 as y, (labels.doc_id * 37 % 101) / 100.0 as s from labels join documents using (doc_id)),
r as (select *, (rank() over (partition by lang order by s) + rank() over (partition by lang order by s) + count(*) over (partition by lang, s) - 1) / 2.0 as rk from s),
g as (select lang, count_if(y) as p, count(*) as n, count_if(y and s >= 0.5) as tp, count_if(s >= 0.5) as called, sum(case when y then rk else 0 end) as ranks from r group by lang),
m as (select lang, p, n, case when p > 0 and p < n then (case when called > 0 then tp / called else 0 end) else 0 end as pr, case when p > 0 and p < n then tp / p else 0 end as re,
case when p > 0 and p < n then (ranks - p * (p + 1) / 2.0) / (p * (n - p)) else 0 end as auc from g)
select lang, round(pr, 6) as precision, round(re, 6) as recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 6) as f1, round(auc, 6) as auc, cast(p as bigint) as support from m""")
def d19_d20_ranking_metrics(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    s = s.select("lang", (F.col("quality") == 1).alias("y"), (F.col("doc_id") * 37 % 101 / 100.0).alias("s"))
    return rounded(metrics.ranking(s, "lang", "y", "s"), "precision", "recall", "f1", "auc").select("lang", "precision", "recall", "f1", "auc", "support")


@query("""with s as (select source, list(distinct lang) as tasks from documents where source is not null group by source), k as (select n_chars // 500 as size, list(distinct lang) as tasks from documents where n_chars is not null group by 1)
select source, size, len(list_intersect(s.tasks, k.tasks))::bigint as shared from s, k where list_has_any(s.tasks, k.tasks)""")
def c15_scorers_by_datasets(spark, d):
    """Pairs of sources and length classes that have a language in common."""
    t = table(spark, d, "documents")
    s = t.filter("source is not null").groupBy("source").agg(F.collect_set("lang").alias("tasks"))
    k = t.filter("n_chars is not null").groupBy(F.expr("n_chars div 500").alias("size")).agg(F.collect_set("lang").alias("tasks"))
    return evaluation.matched(s, k, "source", "size")


@query("""with p as (select source, coalesce(lang, 'und') as lang, l.doc_id, quality, toxic from labels l join documents using (doc_id)),
r as (select source as scorer, lang as dataset, doc_id, case quality when 1 then 'good' else 'poor' end as gold, case when toxic = 1 then 'poor' else 'good' end as said from p),
e as (select scorer, dataset, unnest(list_distinct([gold, said])) as l, gold, said from r),
c as (select scorer, dataset, l, count_if(gold = l and said = l) as tp, count_if(gold = l or said = l) as either from e group by all),
m as (select scorer, dataset, avg(2.0 * tp / (tp + either)) as macro_f1 from c group by all)
select scorer, dataset, n, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1 from m join (select scorer, dataset, count(*) as n, avg((gold = said)::int) as accuracy from r group by all) using (scorer, dataset)""")
def j21_scorer_evaluation(spark, d):
    """Labels of toxicity as predictions of quality, of every source (scorer) over its items in every language (dataset)."""
    p = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("und")).alias("lang")), "doc_id")
    p = p.select(F.col("source").alias("scorer"), F.concat_ws("|", "source", "lang").alias("dataset"), "lang", "doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"), F.when(F.col("toxic") == 1, "poor").otherwise("good").alias("predicted"))
    out = evaluation.evaluated(p.select("scorer", "dataset", "doc_id", "predicted"), p.select("dataset", "doc_id", "label"), "scorer", "dataset", "doc_id")
    return rounded(out, "accuracy", "macro_f1").select("scorer", F.element_at(F.split("dataset", r"\|"), -1).alias("dataset"), "n", "accuracy", "macro_f1")


@query("""with s as (select l_orderkey, l_linenumber, l_linestatus, (l_discount - 0.05) * 40 as logit, l_returnflag = 'N' as truth from lineitem),
o as (select l_linestatus, truth::int as t, (1 / (1 + exp(-logit)) >= 0.6)::int as a, (row_number() over (partition by l_orderkey order by logit desc, l_linenumber, l_linestatus, truth) <= 2)::int as b from s),
k as (select l_linestatus, 'threshold' as rule, t, a as y from o union all select l_linestatus, 'top' as rule, t, b from o),
c as (select l_linestatus, rule, sum(t * y)::double as tp, sum(y)::double as called, sum(t)::double as real from k group by all)
select rule, round(avg(tp / called), 6) as macro_precision, round(avg(tp / real), 6) as macro_recall, round(avg(2 * tp / (called + real)), 6) as macro_f1,
round(sum(tp) / sum(called), 6) as micro_precision, round(sum(tp) / sum(real), 6) as micro_recall, round(2 * sum(tp) / (sum(called) + sum(real)), 6) as micro_f1 from c group by rule""")
def d20_multi_label(spark, d):
    """Sigmoids of scores against a threshold, and the two best of each order, over line states."""
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", ((F.col("l_discount") - 0.05) * 40).cast("double").alias("logit"), (F.col("l_returnflag") == "N").cast("int").alias("truth"))
    ways = {"threshold": evaluation.binarised(s, ["l_orderkey"], "logit", 0.6), "top": evaluation.binarised(s, ["l_orderkey"], "logit", top=2)}
    out = [evaluation.multi_label(x, "l_linestatus", "truth", "on").withColumn("rule", F.lit(k)) for k, x in ways.items()]
    return rounded(out[0].union(out[1]), *(f"{a}_{m}" for a in ("macro", "micro") for m in ("precision", "recall", "f1")))


@query("with a as (select o_orderpriority as task, o_orderstatus as name, avg(o_totalprice) as v from orders group by all) select task, cast(count(*) as bigint) as n, arg_min(name, (-v, name)) as best, round(avg(v), 4) as mean from a group by task")
def d44_c15_best_per_task(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("name")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(metrics.best(a, "task", "name", "v"), "mean", digits=4)


@query("""with r as (select user_id, count(distinct event_type) as labels, count(*) as n from events group by user_id) select user_id, cast(labels as bigint) as labels, cast(n as bigint) as n from r order by labels desc, n desc, user_id limit 8""")
def d41_disagreement(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("labels"), F.count("*").alias("n"))
    return r.orderBy(F.desc("labels"), F.desc("n"), "user_id").limit(8)


@query("with h as (select regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) as h, page_id from pages), s as (select list_extract(string_split(h, '.'), -2) || '.' || list_extract(string_split(h, '.'), -1) as source, page_id from h) select source, cast(count(*) as bigint) as n, string_agg(cast(page_id as varchar), ',' order by page_id) as members from s group by source")
def d11_media_groups(spark, d):
    from ..functions.urls import media_source

    p = table(spark, d, "pages").select(media_source("url").alias("source"), "page_id")
    return p.groupBy("source").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string"))).alias("members"))


@query("select count(distinct source) as sources, cast(count(*) as bigint) as documents, cast(count_if(n_chars > 0) as bigint) as successes, round(avg(n_chars), 6) as mean_chars, cast(sum(len(string_split(text, chr(10)))) as bigint) as lines from documents")
def d35_d38_d39_summary(spark, d):
    t = table(spark, d, "documents")
    return rounded(t.agg(F.countDistinct("source").alias("sources"), F.count("*").alias("documents"), F.count_if(F.col("n_chars") > 0).alias("successes"), F.avg("n_chars").alias("mean_chars"), F.sum(F.size(F.split("text", "\n"))).alias("lines")), "mean_chars")


@query("select strftime(max(o_orderdate), '%Y-%m-%d') as latest from orders")
def d37_l07_high_water(spark, d):
    return incremental.high_water(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "day")


@query("""with g as (select l_returnflag as class, l_linestatus as claim, count(*) as n from lineitem group by all)
select class, claim, n, cast(sum(n) over (partition by class) as bigint) as class_total, round(100.0 * n / sum(n) over (partition by claim), 6) as percent from g""")
def d43_e13_class_totals(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("class"), F.col("l_linestatus").alias("claim")).agg(F.count("*").alias("n"))
    g = g.withColumn("class_total", F.sum("n").over(W.partitionBy("class"))).withColumn("percent", rollup.percent_of(F.col("n"), "claim"))
    return rounded(g, "percent")


@query("with w as (select user_id, date_trunc('minute', ts) as minute, count(*) as n from events group by all) select user_id, cast(max(n) as bigint) as most, cast(count(*) as bigint) as windows from w group by user_id")
def e12_request_windows(spark, d):
    w = table(spark, d, "events").groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("n"))
    return w.groupBy("user_id").agg(F.max("n").alias("most"), F.count("*").alias("windows"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1")
def e11_first_wins(spark, d):
    return dedup.first_by(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query(f"with {DOCS} select doc_id, published_at from docs order by published_at desc nulls last, doc_id limit 25")
def f01_f02_f07_sorted_limit(spark, d):
    return documents(spark, d).select("doc_id", "published_at").orderBy(F.desc_nulls_last("published_at"), "doc_id").limit(25)


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 50")
def f03_f05_f06_top_k(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)


@query("select 'c@@' || c_custkey as id, c_nationkey as nation from customer union all select 's@@' || s_suppkey, s_nationkey from supplier")
def g01_union(spark, d):
    one = table(spark, d, "customer").select(ids.global_id(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("nation"))
    return one.unionByName(table(spark, d, "supplier").select(ids.global_id(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("nation")))


@query(r"select min(doc_id) as doc_id from documents group by regexp_replace(text, '^\s+|\s+$', '', 'g')")
def g02_g03_dedupe_text(spark, d):
    from ..functions.text import strip

    return spread(table(spark, d, "documents")).groupBy(strip("text").alias("t")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("select doc_id from documents except select doc_id from labels where toxic = 1")
def g04_c16_except(spark, d):
    return dedup.without(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").filter("toxic = 1"), ["doc_id"])


@query("select count(*) as n, count(l.doc_id) as shared, round(count(l.doc_id) / count(*), 6) as share from (select distinct doc_id from documents) d left join (select distinct doc_id from labels) l using (doc_id)")
def g05_intersect_ratio(spark, d):
    return rounded(dedup.overlap(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id"), "share")


@query("with o as (select *, case when o_orderstatus = 'O' then 'x' end as w from orders) select o_orderkey from o where o_orderdate >= timestamp '1997-01-01' and o_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1997-01-01') and o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def c17_l01_l06_frontier(spark, d):
    o = table(spark, d, "orders")
    old, new = o.filter("o_orderdate < timestamp '1997-01-01'"), o.filter("o_orderdate >= timestamp '1997-01-01'")
    failed = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return incremental.frontier(new, old, failed, "o_custkey").select("o_orderkey")


@query("select case when o_custkey in (select o_custkey from orders where o_orderdate < timestamp '1994-01-01') then 'stored' when o_custkey in (select c_custkey from customer where c_acctbal < 0) then 'failed' else 'new' end as outcome, count(distinct o_custkey) as n from orders group by all")
def d36_build_outcomes(spark, d):
    o = table(spark, d, "orders")
    failed = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return incremental.outcomes(o, o.filter("o_orderdate < timestamp '1994-01-01'"), failed, "o_custkey")


@query("select doc_id from documents where doc_id % 5 = 0 or doc_id >= 900")
def l02_needs_rebuild(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("fingerprint"), F.lit("s1").alias("chunker"))
    state = t.filter("doc_id < 900").withColumn("fingerprint", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("fingerprint")))
    return incremental.needs_rebuild(t, state, "doc_id", ["fingerprint", "chunker"])


@query("select event_id from events where ts >= timestamp '2024-01-31' - interval 7 day")
def l05_cache_age(spark, d):
    return incremental.fresh(table(spark, d, "events"), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), "7 days").select("event_id")


@query("select doc_id, 'old' as state from documents where doc_id % 4 <> 0 union all select doc_id, 'new' from documents where doc_id % 4 = 0")
def a17_upsert(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    return incremental.upsert(t.withColumn("state", F.lit("old")), t.filter("doc_id % 4 = 0").withColumn("state", F.lit("new")), "doc_id")


@query("select user_id, event_id, event_type from events where user_id in (select user_id from events where event_type = 'signup')")
def a16_a18_findings(spark, d):
    nested = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", "event_type")).alias("findings"))
    has = nested.filter(F.exists("findings", lambda f: f["event_type"] == "signup"))
    return has.select("user_id", F.explode("findings").alias("f")).select("user_id", "f.event_id", "f.event_type")


ASOF = """with v as (select user_id, event_id, ts from events where event_type = 'view'), c as (select user_id, event_id, ts from events where event_type = 'click')
select c.event_id, (select max(v.event_id) from v where v.user_id = c.user_id and v.ts = (select max(ts) from v v2 where v2.user_id = c.user_id and v2.ts <= c.ts)) as speaker from c"""


@query(ASOF)
def c10_as_of(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    out = actors.nearest_before(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "user_id", "ts", "ts", "event_id")
    return out.select("event_id", "speaker")


@query("""with a as (select conv_id as doc_id, turn * 10 as s, turn * 10 + 12 as e from conversations), select_b as (select conv_id as doc_id, turn * 10 + 5 as s, turn * 10 + 9 as e from conversations where role = 'user')
select a.doc_id, cast(a.s as bigint) as start, cast(b.s as bigint) as other_start from a join select_b b on a.doc_id = b.doc_id and a.e > b.s and a.s < b.e""")
def c12_overlap_join(spark, d):
    c = table(spark, d, "conversations")
    t = F.col("turn") * 10
    a = c.select(F.col("conv_id").alias("doc_id"), t.alias("start"), (t + 12).alias("end"))
    b = c.filter("role = 'user'").select(F.col("conv_id").alias("doc_id"), (t + 5).alias("start"), (t + 9).alias("end"))
    return actors.overlapping(a, b, "doc_id").select("doc_id", "start", "other_start")


@query()
def i11_i12_i13_c11_attributions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    s = actors.spans(docs)
    claims, mentions = s.filter(F.col("kind").isin("QUOTE", "REPORTED")), s.filter(F.col("kind").isin("PERSON", "ORG"))
    return actors.attribution(claims, mentions, docs=docs)


@query()  # SQL's word characters are ASCII's only, the operator's are Unicode's: held against plain Python in the tests
def d14_actor_counts(spark, d):
    s = actors.spans(table(spark, d, "documents").select("doc_id", "text"))
    return s.filter(F.col("kind").isin("PERSON", "ORG")).groupBy(F.col("span").alias("actor")).agg(F.count("*").alias("n"))


@query("select doc_id from documents order by md5('7|' || doc_id), doc_id limit 40")
def k01_k05_k06_sample(spark, d):
    return sampling.take(table(spark, d, "documents").select("doc_id"), 40, 7, "doc_id")


ALLOC = """with c as (select lang, count(*) as n from documents group by lang), b as (select *, floor(101 * n / sum(n) over ()) as base from c),
q as (select lang, n, base + case when row_number() over (order by md5('7|' || lang), lang) <= 101 - sum(base) over () then 1 else 0 end as quota from b)"""


@query(ALLOC + " select lang, cast(n as bigint) as n, cast(quota as bigint) as quota from q")
def k02_allocation(spark, d):
    c = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return sampling.allocate(c, "lang", 101, 7)


@query(ALLOC + ", r as (select lang, doc_id, row_number() over (partition by lang order by md5('7|' || doc_id), doc_id) as k from documents) select r.lang, doc_id from r join q using (lang) where k <= quota")
def k03_k04_stratified_sample(spark, d):
    t = table(spark, d, "documents").select("lang", "doc_id")
    q = sampling.allocate(t.groupBy("lang").agg(F.count("*").alias("n")), "lang", 101, 7)
    return sampling.stratified(t, "lang", q, 7, ["doc_id"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels) order by md5('9|' || doc_id), doc_id limit 30")
def k07_top_up(spark, d):
    left = dedup.without(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])
    return sampling.take(left, 30, 9, "doc_id")


@query("with f as (select doc_id, ntile(5) over (order by md5('3|' || doc_id), doc_id) - 1 as fold, length(text) as n from documents) select fold, cast(count(*) as bigint) as n, round(avg(n), 6) as mean_chars from f group by fold")
def d21_folds(spark, d):
    f = sampling.folds(table(spark, d, "documents"), 5, 3, "doc_id")
    return rounded(f.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean_chars")), "mean_chars")


@query("with s as (select ('0x' || substr(md5('5|' || doc_id), 1, 8))::bigint / 4294967296.0 as u from documents) select case when u < 0.1 then 'test' when u < 0.2 then 'dev' else 'train' end as part, cast(count(*) as bigint) as n from s group by all")
def j19_split(spark, d):
    return sampling.split(table(spark, d, "documents"), 5, "doc_id").groupBy("part").agg(F.count("*").alias("n"))


@query("select lang, cast(sum(quality) as bigint) as quality, cast(sum(toxic) as bigint) as toxic from labels join documents using (doc_id) group by lang")
def j19_j20_label_matrix(spark, d):
    long = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").unpivot(["doc_id", "lang"], ["quality", "toxic"], "label", "v")
    return long.groupBy("lang").pivot("label", ["quality", "toxic"]).agg(F.sum("v"))


@query(r"""with w as (select doc_id, regexp_extract(text, '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)', 1) as w, text is null as nothing from documents)
select doc_id, length(regexp_extract(w, '[^a-z].*', 0))::bigint as result, nothing or not regexp_matches(w, '[^a-z]') as failed from w where not (nothing or not regexp_matches(w, '[^a-z]'))
union all select doc_id, null, true from w where nothing or not regexp_matches(w, '[^a-z]')""")
def b30_error_capture(spark, d):
    """A step that fails on texts whose first word has small letters only, and on null texts."""

    def tail(t):
        return len(re.search("[^a-z].*", re.search(r"[^\x20\x09-\x0D]+", t or "")[0])[0])

    out = filters.captured(table(spark, d, "documents").select("doc_id", "text"), "text", tail, "long")
    return out.select("doc_id", "result", F.col("error").isNotNull().alias("failed"))


@query(r"""with s as (select conv_id, regexp_replace(string_agg(trim(text), ' ' order by turn), '\s+', ' ', 'g') as t from conversations where text is not null group by conv_id),
c as (select conv_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\[(music|applause|laughter|crowd noise)\]', '', 'gi'), '\b(uh|um|ah|oh)\b', '', 'gi'), '[.]{2,}', '.', 'g'), '[?]{2,}', '?', 'g'), '!{2,}', '!', 'g')) as t from s),
a as (select conv_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), '. ') as t from c),
b as (select conv_id, list_filter(list_transform(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as l from a)
select conv_id, coalesce(list_reduce(list_prepend({'s': '', 'out': '', 'n': 0}, list_transform(l, lambda x: {'s': x, 'out': '', 'n': 0})), lambda a, x: {'s': '',
  'out': a.out || case when a.out = '' then '' when a.n = 0 then chr(10) || chr(10) else ' ' end || x.s,
  'n': case when a.n + 1 >= 2 or regexp_matches(lower(x.s), 'however|nevertheless|meanwhile|furthermore|moreover|on the other hand|in contrast|additionally|further|now|then|next|finally|in conclusion') then 0 else a.n + 1 end}).out, '') as transcript from b""")
def i10_transcripts(spark, d):
    """The turns of each conversation as a transcript."""
    t = table(spark, d, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    return t.select("conv_id", models.transcript(F.transform("s", lambda x: x["text"])).alias("transcript"))


@query("""select doc_id, case when l.doc_id is not null then 'new' else 'old' end as state, case when l.doc_id is not null then l.n else 0 end as n
from documents d left join (select doc_id, sum(quality + toxic)::bigint as n from labels group by doc_id) l using (doc_id)""")
def a17_a18_keyed_upsert(spark, d):
    """All documents, then the labelled ones with findings, by upserts into buckets; read back by the index."""
    store = keyed.KeyedTable(spark, f"{shared_folder(spark).rstrip('/')}/textorium/keyed-{uuid.uuid4().hex}", "url")
    docs = table(spark, d, "documents").select(F.concat(F.lit("https://x.org/"), "doc_id").alias("url"), "doc_id", F.array().cast("array<string>").alias("findings"), F.lit("old").alias("state"))
    store.upsert(docs)
    n = table(spark, d, "labels").groupBy("doc_id").agg(F.sum(F.col("quality") + F.col("toxic")).cast("int").alias("n"))
    store.upsert(docs.join(n, "doc_id").select("url", "doc_id", F.array_repeat(F.lit("x"), F.col("n")).alias("findings"), F.lit("new").alias("state")))
    return store.index().join(store.rows().select("url", "state"), "url").select("doc_id", "state", "n")


@query("""select doc_id, case when toxic = 1 then 'toxic' when quality = 1 then 'good' end as extractor, case when toxic = 1 or quality = 1 then 1 else 0 end as n,
case when not (toxic = 1 or quality = 1) and text is null then 'no text' end as error from labels join documents using (doc_id)""")
def a37_first_extractor(spark, d):
    """Labelled documents through two extractors; what neither reads stays, without findings."""
    docs = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    by = lambda column, word: lambda x: x.select("doc_id", F.when(F.col(column) == 1, F.array(F.lit(word))).alias("findings"), F.when(F.col("text").isNull(), "no text").alias("error"))
    out = keyed.first_to_find(docs, "doc_id", [("toxic", by("toxic", "t")), ("good", by("quality", "g"))])
    return out.select("doc_id", "extractor", F.size("findings").alias("n"), "error")
