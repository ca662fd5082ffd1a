"""Operator 3: mixing sources to target weights by Sainte-Laguë apportionment.

Targets are the sources' weighted shares of `share` times all words, stopped at `max_repeats` times a source's own
size with the excess shared out again. The mix is counted in blocks of `block_words` words; blocks go to sources by
highest quotients target / (2 s - 1), shard by shard, which gives integer quotas. A source's documents stand in
a seeded order and its quota takes that stream's blocks from the front, going round at most `max_repeats` times.

Cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own and comes last;
equal seeded positions (repeated rows) are ordered by id, size and text hash, so that reruns agree; an empty table gives an
empty result; other columns of the input are ignored.

The table of sources has a row per source (the weights' own dimension), so windows over all of it stay small;
documents are only ever dealt by (source, bucket of the seeded order), which splits a hot source evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_rows, words, written

WEIGHTS = (5, 2, 1)
ROWS_PER_BUCKET = 20_000
LEAST_BUCKETS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """(source, source_size, weight, target): water-filling in closed form over sources ordered by cap / weight."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("cap", (max_repeats * F.col("source_size")).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    up_to = W.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("total", share * F.sum("source_size").over(every))
    full = F.sum("cap").over(up_to) + F.col("level") * (F.sum("weight").over(every) - F.sum("weight").over(up_to))
    s = s.withColumn("full", full <= F.col("total"))
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * left / open_weight)
    return s.select("source", "source_size", "weight", target.alias("target"))


def block_quotas(targets: DataFrame, block_words: int = 32, shards: int = 8, max_repeats: int = 2) -> DataFrame:
    """(source, source_size, target, upto): blocks of the source in the first 1, 2, ... shards, as an array.

    Apportionment by highest quotients never takes a seat back when the house grows, so a shard's quota is the
    difference of two neighbours. Rounding target / divisor misses the house by half a seat a source at most; so only
    quotients between those two bounds, about two a source, have to be ranked.
    """
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = targets.withColumn("all_target", F.sum("target").over(every)).withColumn("n", F.count("*").over(every))
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    t = t.withColumn("house", F.floor(F.round(F.col("all_target") / block_words) * F.col("shard") / shards))
    part = F.when(F.col("all_target") > 0, F.col("target") / F.col("all_target")).otherwise(0.0)
    most = F.ceil(F.col("source_size") / block_words) * max_repeats
    t = t.withColumn("hi", F.least(most, F.floor(part * (F.col("house") + F.col("n") / 2) + 0.5) + 1))
    t = t.withColumn("lo", F.least("hi", F.greatest(F.lit(0), F.floor(part * (F.col("house") - F.col("n") / 2) + 0.5))))
    t = t.withColumn("free", F.col("house") - F.sum("lo").over(W.partitionBy("shard")))
    t = t.withColumn("seat", F.explode_outer(F.when(F.col("hi") > F.col("lo"), F.sequence(F.col("lo") + 1, F.col("hi")))))
    rank = W.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("seat") - 1)).desc_nulls_last(), F.col("source").asc_nulls_last(), "seat")
    t = t.withColumn("won", (F.col("seat").isNotNull() & (F.row_number().over(rank) <= F.col("free"))).cast("long"))
    q = t.groupBy("source", "shard").agg((F.first("lo") + F.sum("won")).alias("upto"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    return q.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("upto"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", seed: int = 17, weights=WEIGHTS,
        share: float = 1.5, max_repeats: int = 2, block_words: int = 32, shards: int = 8) -> DataFrame:
    """(id, th, of_source, size, source_size, target, taken, shard, spans), a row per row of docs; th is the text's XXH64.

    spans: for each time round, the words [start, end) of the document that the mix takes; shard: the one its first
    taken word falls in, null if none is taken.
    """
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sizes = as_rows(docs, id_col, source, "text").select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.xxhash64("text").alias("th"), F.size(words("text")).cast("long").alias("size"), key.alias("key"))
    sizes = written(sizes, "mix")
    quotas = written(block_quotas(source_targets(sizes, weights, share, max_repeats), block_words, shards, max_repeats), "quotas")

    buckets = min(16**5, max(LEAST_BUCKETS, sizes.count() // ROWS_PER_BUCKET))
    place = F.conv(F.substring("key", 1, 5), 16, 10).cast("long")
    sizes = sizes.withColumn("bucket", F.floor(place * buckets / 16**5))
    starts = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    starts = starts.join(quotas, starts["source"].eqNullSafe(quotas["source"])).select(
        starts["source"].alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target", "upto"
    )
    within = W.partitionBy("source", "bucket").orderBy("key", "id", "size", "th").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = sizes.join(starts, sizes["source"].eqNullSafe(F.col("s")) & (sizes["bucket"] == F.col("b")))
    d = d.withColumn("lo", F.col("start") + F.col("offset"))
    d = d.withColumn("stream", F.least(F.element_at("upto", -1) * block_words, max_repeats * F.col("source_size")))
    laps = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    ends = F.transform(laps, lambda p: F.least(F.col("size"), F.greatest(F.lit(0), F.col("stream") - p * F.col("source_size") - F.col("lo"))))
    d = d.withColumn("ends", F.filter(ends, lambda e: e > 0))
    first_block = F.floor(F.col("lo") / block_words)
    return d.select(
        F.col("id").alias(id_col), "th", sizes["source"].alias("of_source"), "size", "source_size", "target",
        F.aggregate("ends", F.lit(0).cast("long"), lambda a, e: a + e).alias("taken"),
        F.when(F.size("ends") > 0, F.size(F.filter("upto", lambda u: u <= first_block))).alias("shard"),
        F.transform("ends", lambda e: F.struct(F.lit(0).cast("long").alias("start"), e.alias("end"))).alias("spans"),
    )


def sql(block_words: int = 32, seed: int = 17, rows: str = "documents") -> str:
    """The same mix for DuckDB, with one plain window per source."""
    return f"""
with z as (select doc_id, source, cast(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as bigint) as size,
  md5('{seed}|' || coalesce(cast(doc_id as varchar), 'null')) as k from {rows}),
s as (select source, cast(sum(size) as bigint) as source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from z group by source),
c as (select *, cast(2 * source_size as double) as cap, 2.0 * source_size / w as lev, 1.5 * sum(source_size) over () as total from s),
f as (select *, sum(cap) over o + lev * (sum(w) over () - sum(w) over o) <= total as is_full from c
  window o as (order by lev, source nulls last rows between unbounded preceding and current row)),
t as (select source, source_size, case when is_full then cap else w * (total - sum(case when is_full then cap else 0 end) over ())
  / sum(case when is_full then 0 else w end) over () end as target from f),
b as (select *, sum(target) over () as allt, count(*) over () as n, round(sum(target) over () / {block_words}) as house from t),
g as (select *, case when allt > 0 then target / allt else 0 end as part from b),
h as (select *, least(ceil(source_size / {block_words}) * 2, floor(part * (house + n / 2) + 0.5) + 1) as hi from g),
l as (select *, least(hi, greatest(0, floor(part * (house - n / 2) + 0.5))) as lo from h),
p as (select *, house - sum(lo) over () as free from l),
seats as (select source, free, target, seat from p, unnest(range(cast(lo as bigint) + 1, cast(hi as bigint) + 1)) u(seat)),
won as (select source, count(*) as n_won from (select *, row_number() over (order by target / (2 * seat - 1) desc, source nulls last, seat) as rk from seats) where rk <= free group by source),
q as (select p.source, source_size, target, least((lo + coalesce(n_won, 0)) * {block_words}, 2 * source_size) as stream
  from p left join won on p.source is not distinct from won.source),
d as (select z.doc_id, z.size, q.source_size, q.target, q.stream,
  sum(z.size) over (partition by z.source order by z.k, z.doc_id, z.size rows between unbounded preceding and current row) - z.size as pos
  from z join q on z.source is not distinct from q.source)
select doc_id, size, source_size, cast(target as double) as target, cast(least(size, greatest(0, stream - pos)) + least(size, greatest(0, stream - source_size - pos)) as bigint) as taken from d
"""


def mixed(docs: DataFrame, id_col: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes from, with all their columns and taken, shard and spans.

    Rows of one id, text and source are told apart by a number, so that each gets the words of one row of the mix.
    """
    keys = ["_own_id", "_own_th", "_own_source"]
    m = mix(docs, id_col, source, **options).select(F.col(id_col).alias(keys[0]), F.col("th").alias(keys[1]), F.col("of_source").alias(keys[2]), "taken", "shard", "spans")
    m = m.withColumn("_own_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("taken")))).filter("taken > 0")
    d = docs.drop("taken", "shard", "spans").withColumns({"_own_h": F.xxhash64("text")})
    d = d.withColumn("_own_k", F.row_number().over(W.partitionBy(id_col, "_own_h", source).orderBy(F.lit(0))))
    same = d[id_col].eqNullSafe(m[keys[0]]) & (d["_own_h"] == m[keys[1]]) & d[source].eqNullSafe(m[keys[2]]) & (d["_own_k"] == m["_own_n"])
    return d.join(m.hint("merge"), same).drop("_own_h", "_own_k", "_own_n", *keys)
