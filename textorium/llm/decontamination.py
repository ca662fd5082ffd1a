"""Operator 7: benchmark decontamination by spaced-seed hashing.

Fixed masks of five words out of a short span are laid over every position of test items and documents; masked-out
words are ignored, so that a substituted word leaves other seeds whole. Equal hashes are hits; every hit names a
diagonal (document word minus item word), along which the words are then compared one by one: an overlap counts if
some stretch of REGION words (the whole item if it is shorter) agrees in at least `agree` of them. DataFrame
expressions only.

Words are lower-cased runs of letters and digits. Cases: null texts have no words; null ids are ids of their own; rows
with the same id and text give one result; an item without words matches nothing; empty tables give an empty result;
other columns are ignored.

Items of up to seven words hold too few of these seeds. They have masks of their own, laid over the whole item: all its
words, and from five words on (where one in five may differ) all but one, for each one. Documents are looked
through for the lengths of short items that the benchmark holds, and for none if it holds none.

The table of seeds grows with the benchmark. It is counted, and joined in as many broadcast blocks of at most
BLOCK_SEEDS rows as it takes; the corpus side is never shuffled for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Offsets of the words that count, the two masks of weight five that together miss least at one substitution in five.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
REGION = 13
#: Words of the longest item with masks of its own.
SHORT = 7
BLOCK_SEEDS = 500_000


def tokens(text: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(source: str):
    """Arrays of hashes by position, one after the other for each mask, of the words' own hashes in `source`."""
    parts = []
    for k, m in enumerate(MASKS):
        picked = ", ".join(f"{source}[i + {o}]" for o in m)
        parts.append(f"if(size({source}) > {m[-1]}, transform(sequence(0, size({source}) - {m[-1] + 1}), i -> xxhash64({picked}, {k})), cast(array() as array<bigint>))")
    return parts


def hits(docs: DataFrame, seed_table: DataFrame) -> DataFrame:
    """(id, th, item, n_item, diagonal), distinct: hits of one block of seeds, broadcast."""
    d = docs.select("id", "th", F.transform(tokens("text"), lambda w: F.xxhash64(w)).alias("w"))
    first, second = seeds("w")
    d = d.select("id", "th", F.size("w").alias("n"), F.posexplode(F.expr(f"concat({first}, {second})")).alias("at", "seed"))
    d = d.join(F.broadcast(seed_table), "seed")
    cut = F.greatest(F.lit(0), F.col("n") - MASKS[0][-1])  # positions of the first mask
    place = F.when(F.col("at") < cut, F.col("at")).otherwise(F.col("at") - cut)
    return d.select("id", "th", "item", "n_item", (place - F.col("place")).alias("diagonal")).distinct()


def short_masks(n: int, agree: float) -> list[tuple[int, ...]]:
    """Masks over an item of n words, of which one is whole wherever `agree` of the words are."""
    every = tuple(range(n))
    return [every] if n - 1 < agree * n else [every[:k] + every[k + 1 :] for k in range(n)]


def short_seeds(source: str, n: int, agree: float) -> str:
    """An array of (seed, place) of the masks for items of n words, at every place of `source`."""
    hashes = ", ".join(f"xxhash64({', '.join(f'{source}[i + {o}]' for o in m)}, {100 * n + k})" for k, m in enumerate(short_masks(n, agree)))
    each = f"flatten(transform(sequence(0, size({source}) - {n}), i -> transform(array({hashes}), s -> struct(s as seed, i as place))))"
    return f"if(size({source}) >= {n}, {each}, cast(array() as array<struct<seed:bigint,place:int>>))"


def short_hits(docs: DataFrame, items: DataFrame, agree: float) -> DataFrame | None:
    """As `hits`, for the items (item, ith, w) of up to SHORT words; None if there are none."""
    few = items.filter(F.size("w").between(1, SHORT))
    lengths = sorted(r["n"] for r in few.select(F.size("w").alias("n")).distinct().collect())  # SHORT at most
    if not lengths:
        return None
    d = docs.select("id", "th", F.transform(tokens("text"), lambda w: F.xxhash64(w)).alias("w"))
    d = d.select("id", "th", F.explode(F.expr(f"concat({', '.join(short_seeds('w', n, agree) for n in lengths)})")).alias("x")).select("id", "th", "x.*")
    own = [few.filter(F.size("w") == n).select("item", "ith", F.explode(F.expr(short_seeds("w", n, agree))).alias("x")).select(
        F.col("x.seed").alias("seed"), F.struct("item", "ith").alias("item"), F.lit(n).alias("n_item")) for n in lengths]
    own = written(reduce(DataFrame.union, own).distinct(), "short-seeds")
    blocks = max(1, -(-own.count() // BLOCK_SEEDS))
    found = [d.join(F.broadcast(own.filter(F.pmod(F.xxhash64(F.col("seed"), F.lit(1)), F.lit(blocks)) == b)), "seed") for b in range(blocks)]
    return reduce(DataFrame.union, found).select("id", "th", "item", "n_item", F.col("place").alias("diagonal")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", agree: float = 0.8) -> DataFrame:
    """(id, th, item, first_word, last_word, n_equal): overlaps of documents with items, a row per pair.

    first_word and last_word bound the agreeing stretches in the document's words (last exclusive); n_equal: equal
    words on the best diagonal; th: XXH64 of the text, to tell rows with the same id apart.
    """
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), "text")
    items = benchmark.select(F.col(item_col).alias("item"), F.xxhash64("text").alias("ith"), tokens("text").alias("item_words")).distinct()
    t = items.withColumn("w", F.transform("item_words", lambda w: F.xxhash64(w)))
    first, second = seeds("w")
    parts = [t.select("item", "ith", F.size("w").alias("n_item"), F.posexplode(F.expr(x)).alias("place", "seed")) for x in (first, second)]
    t = written(parts[0].union(parts[1]).select("seed", F.struct("item", "ith").alias("item"), "n_item", "place").distinct(), "seeds")
    blocks = max(1, -(-t.count() // BLOCK_SEEDS))
    found = [hits(d, t.filter(F.pmod(F.xxhash64(F.col("seed"), F.lit(1)), F.lit(blocks)) == b)) for b in range(blocks)]
    if (short := short_hits(d, items.withColumn("w", F.transform("item_words", lambda w: F.xxhash64(w))), agree)) is not None:
        found.append(short)
    found = written(reduce(DataFrame.union, found).distinct().groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(F.collect_list(F.struct("item", "n_item", "diagonal")).alias("hits")), "hits")

    d = d.join(found, d["id"].eqNullSafe(found["i"]) & d["th"].eqNullSafe(found["h"])).withColumn("w", tokens("text"))
    d = d.select("id", "th", F.explode(F.expr(
        "transform(hits, x -> struct(x.item as item, x.diagonal as diagonal, greatest(0, x.diagonal) as start,"
        " slice(w, greatest(0, x.diagonal) + 1, greatest(0, x.n_item + least(0, x.diagonal))) as words))"
    )).alias("x")).select("id", "th", "x.*")
    items = items.select(F.struct("item", "ith").alias("of"), "item_words")
    d = d.join(items, F.col("item").eqNullSafe(F.col("of")))
    d = d.withColumn("equal", F.expr(
        "transform(words, (a, k) -> int(a = item_words[k + greatest(0, -diagonal)]))"
    )).withColumn("span", F.least(F.lit(REGION), F.size("item_words")))
    d = d.withColumn("good", F.expr(
        f"if(size(equal) >= span, filter(sequence(0, size(equal) - span), k -> aggregate(slice(equal, k + 1, span), 0, (a, e) -> a + e) >= {agree} * span), cast(array() as array<int>))"
    )).filter(F.size("good") > 0)
    return d.groupBy("id", "th", F.col("item.item").alias("item")).agg(
        F.min(F.col("start") + F.array_min("good")).cast("long").alias("first_word"),
        F.max(F.col("start") + F.array_max("good") + F.col("span")).cast("long").alias("last_word"),
        F.max(F.aggregate("equal", F.lit(0), lambda a, e: a + e)).cast("long").alias("n_equal"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", agree: float = 0.8) -> DataFrame:
    """(id, item, first_word, last_word, n_equal): a row per document and item that it holds."""
    o = overlaps(docs, benchmark, id_col, item_col, agree)
    o = o.groupBy("id", "item").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("n_equal").alias("n_equal"))
    return o.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "first_word", "last_word", "n_equal")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", agree: float = 0.8) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    bad = written(overlaps(docs, benchmark, id_col, item_col, agree).select(F.col("id").alias("_own_id"), F.col("th").alias("_own_th")).distinct(), "contaminated")
    d = docs.withColumn("_own_h", F.xxhash64("text"))
    return d.join(bad.hint("merge"), d[id_col].eqNullSafe(bad["_own_id"]) & (d["_own_h"] == bad["_own_th"]), "left_anti").drop("_own_h")
