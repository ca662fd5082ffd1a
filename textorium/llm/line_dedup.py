"""Operator 6: line dedup by content-defined chunks of lines.

Every line is hashed; a rolling hash over WINDOW line hashes is local to a few lines, and a chunk ends where it has
a local minimum, so that boundaries move with the content and chunks have two lines or more (the first and the
last may be shorter). Chunks that occur again, by hash and then by their bytes, are removed everywhere but at their
first occurrence, in the order of document id (null last), text hash and place in the text. A chunk counts if two
of its lines or more hold a word. DataFrame expressions only.

Chunks alone leave a passage's edges, and short passages, where no boundary falls. For `whole`, each pair of worded
lines that follow one another (with the blank ones between) counts as a chunk does: the pairs of a passage overlap, so
that every repeated passage of two worded lines or more goes from its first to its last. A line goes only where an
earlier copy stands; a passage of one line stays, unless it goes with a neighbour.

Cases: null text stays null and has no lines; rows with the same id and text are one document and end alike; an empty
table gives an empty result; `dedup` keeps the input's other columns (its own begin with an underscore).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 2
PRIME = 2147483647
BASE = 1000003


def chunks(docs: DataFrame, id_col: str, text: str = "text", whole: bool = False) -> DataFrame:
    """(id, th, start, n, key): th tells texts apart; start and n are the lines of a chunk or, for whole, of a pair."""
    d = docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(F.col(text), "\n").alias("lines"))
    d = d.withColumn("h", F.transform("lines", lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME).cast("long"))))
    rolled = "h[i]" if WINDOW == 1 else "+".join(f"h[i - {k}] * {pow(BASE, k, PRIME)}L % {PRIME}L" for k in range(WINDOW))
    d = d.withColumn("r", F.expr(f"transform(h, (x, i) -> if(i < {WINDOW - 1}, x, pmod({rolled}, {PRIME}L)))"))
    d = d.withColumn("ends", F.expr(
        "concat(if(size(r) > 2, filter(sequence(2, size(r) - 1), e -> r[e - 1] < r[e - 2] and r[e - 1] <= r[e]), array()), array(size(r)))"
    ))
    spans = (
        "filter(transform(ends, (e, k) -> struct(if(k = 0, 0, ends[k - 1]) as start, e - if(k = 0, 0, ends[k - 1]) as n)),"
        " c -> size(filter(slice(worded, c.start + 1, c.n), x -> x)) > 1)"
    )
    d = d.withColumn("worded", F.transform("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("spans", F.expr(spans))
    if whole:
        d = d.withColumn("w", F.expr("filter(transform(worded, (x, i) -> if(x, i, -1)), i -> i >= 0)"))
        d = d.withColumn("spans", F.expr(
            "array_distinct(concat(spans, if(size(w) > 1, transform(slice(w, 2, greatest(size(w) - 1, 0)),"
            " (e, k) -> struct(w[k] as start, e - w[k] + 1 as n)), array())))"
        ))
    return d.select("id", "th", F.explode(F.expr("transform(spans, c -> struct(c.start, c.n, xxhash64(slice(lines, c.start + 1, c.n)) as key))")).alias("c")).select("id", "th", "c.*")


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(id, th, cuts): for each document that loses lines, the lines to go as sorted (start, n = 1).

    Hashes alone travel first; bytes follow only for hashes that stand more than once. Copies of a chunk meet as
    one row a task before the shuffle.
    """
    c = chunks(docs, id_col, text, whole)
    # Both sides of each join are plain shuffles, whose hot keys Spark splits; counts and minima are merged in each task first.
    many = written(c.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"), "chunk-keys")
    again = c.join(many.hint("merge"), "key", "left_semi").groupBy("id", "th").agg(F.collect_list(F.struct("start", "n", "key")).alias("spans"))
    again = written(again, "chunk-hashes").toDF("_id", "_th", "spans")
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(F.col(text), "\n").alias("lines"))
    d = d.join(again.hint("merge"), d["id"].eqNullSafe(again["_id"]) & (d["th"] == again["_th"]))
    d = d.select("id", "th", F.explode(F.expr("transform(spans, c -> struct(c.key, c.start, c.n, array_join(slice(lines, c.start + 1, c.n), '\n') as chunk))")).alias("c"))
    same = written(d.select("id", "th", "c.*"), "chunk-candidates")
    place = F.struct(F.col("id").isNull().alias("o"), F.col("id").alias("i"), F.col("th").alias("t"), F.col("start").alias("s"))
    firsts = same.groupBy("key", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    later = same.join(written(firsts, "chunk-firsts").hint("merge"), ["key", "chunk"]).filter(~place.eqNullSafe(F.col("first")))
    lines = later.select("id", "th", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("start"))
    return lines.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(1).alias("n")))).alias("cuts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """The rows of docs with the repeated chunks (for whole, the repeated passages) cut out of their text, and _n_lines, _n_removed (lines)."""
    gone = written(repeated(docs, id_col, text, whole), "chunk-cuts").select(F.col("id").alias("_own_id"), F.col("th").alias("_own_th"), F.col("cuts").alias("_own_cuts"))
    d = docs.withColumn("_own_h", F.xxhash64(text))
    # The cuts grow with the corpus: they are never broadcast, so that the plan is one at every size.
    d = d.join(gone.hint("merge"), d[id_col].eqNullSafe(gone["_own_id"]) & (d["_own_h"] == gone["_own_th"]), "left")
    d = d.withColumn("_own_lines", F.split(F.col(text), "\n"))
    pieces = F.expr("""flatten(transform(sequence(0, size(_own_cuts)), k -> slice(_own_lines,
        if(k = 0, 1, _own_cuts[k - 1].start + _own_cuts[k - 1].n + 1),
        if(k = size(_own_cuts), size(_own_lines), _own_cuts[k].start) - if(k = 0, 0, _own_cuts[k - 1].start + _own_cuts[k - 1].n))))""")
    d = d.withColumn("_n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size("_own_lines")).cast("long"))
    d = d.withColumn("_n_removed", F.coalesce(F.expr("aggregate(_own_cuts, 0L, (a, c) -> a + c.n)"), F.lit(0)).cast("long"))
    d = d.withColumn(text, F.when(F.col("_own_cuts").isNotNull(), F.array_join(pieces, "\n")).otherwise(F.col(text)))
    return d.drop("_own_h", "_own_id", "_own_th", "_own_cuts", "_own_lines")
