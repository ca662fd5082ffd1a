"""Near copies by five-word shingles for the pipeline: covering SimHash finds candidates, exact Jaccard decides.

Each text has PRINTS fingerprints of POSITIONS bits, majorities over the hashes of its distinct words: a changed word changes
one feature there, but five shingles, so that texts of Jaccard 0.8 mostly differ in a few bits only. Covering masks
of RADIUS (operator 9) make every pair within the radius, in any of the fingerprints, meet in some bucket, and most
pairs a few bits beyond it: the guarantee is one of bits, and recall at a Jaccard of 0.8 is measured, not proven. Pairs of a bucket
that differ in at most FAR bits of all fingerprints and whose sizes allow the similarity are held against their
whole sets of shingles; only pairs of `similar` hundredths or more are linked.

A bucket's pairs are never all made. Every member is held against its bucket's pivot by min-wise sketches of both; where
they say LOOSE or more, the two are kin. A pair of Jaccard 0.8 is about equally similar to any third text (its distance
is a metric), so either both are kin of the pivot, or both are under CLOSE and stay for the bucket's next pivot. All that kinship reaches
is a clan, and each clan's texts are dealt once, whatever the number of tables they met in, to pairs of blocks of bounded size, where
every pair is held exactly against the other by bits of its common shingles. Only spanning links of similar texts leave a block. What
ROUNDS pivots leave in a bucket, which is kin to none of them, is compared pair by pair, each pair in the first table it meets in.

Cases: words as in operator 9; a text of fewer words than a shingle is one shingle, a null or empty one is a
copy of the others without words; texts of the same words are one before anything is compared; a null id comes after
all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, written
from .simhash import components, covering_masks, keep_least

#: Similarity in hundredths.
SIMILAR = 80
#: Radius that the masks cover in each of the fingerprints, their number and bits, and the most bits of all of them that a candidate pair differs in.
RADIUS, PRINTS, POSITIONS, FAR = 5, 2, 56, 28
#: Members of a block, and their shingles.
BLOCK, BLOCK_GRAMS = 1024, 1 << 18
#: Numbers of a sketch, a byte each; what makes texts kin, and what keeps them for another pivot; pivots of a bucket.
SKETCH, LOOSE, CLOSE, ROUNDS = 64, 0.1, 0.4, 2
#: Rows that a task deals to the tables' buckets.
DEALT = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    w = _words(text)
    if len(w) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    n = len(h) - shingle + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(shingle):
        out = (out ^ h[i : i + n]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prints(text: str | None) -> list[int]:
    """The fingerprints of the distinct words, as signed numbers; zeros for a text without words."""
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in set(_words(text))], dtype=np.uint64)
    out = []
    for _ in range(PRINTS):
        on = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) * 2 > len(h)
        on[POSITIONS:] = False
        out.append(int(np.packbits(on, bitorder="little").view("<i8")[0]))
        h = (h ^ (h >> np.uint64(31))) * MIX
        h ^= h >> np.uint64(29)
    return out


def sketch(hashes: np.ndarray) -> bytes:
    """A byte of each of SKETCH minima over the shingles' hashes, each under a mixing of its own."""
    if not len(hashes):
        return bytes(SKETCH)
    out = np.empty(SKETCH, dtype=np.uint8)
    for k in range(SKETCH):
        h = (hashes ^ np.uint64((k + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1)) * MIX
        out[k] = (h ^ (h >> np.uint64(32))).min() & np.uint64(255)
    return out.tobytes()


def described(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(id, th, t, n, f, s), a row per row of docs; th tells texts apart, t their words; n: distinct shingles; f: fingerprints; s: sketch. No shuffle."""

    def run(batches):
        for b in batches:
            g = [grams(x, shingle) for x in b["text"]]
            t = [xxhash.xxh64_intdigest(b" ".join(_words(x)), 42) for x in b["text"]]
            yield pd.DataFrame({
                "id": b["id"], "th": b["th"], "t": np.array(t, dtype=np.uint64).view(np.int64),
                "n": np.array([len(x) for x in g], dtype=np.int64), "f": [prints(x) for x in b["text"]], "s": [sketch(x) for x in g],
            })

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"id {kind}, th long, t long, n long, f array<long>, s binary")


def table_masks() -> list[int]:
    return [m % (1 << POSITIONS) for m in covering_masks(RADIUS)]


def buckets(texts: DataFrame) -> DataFrame:
    """(v, key, t): the members of all buckets of two texts or more; v numbers the tables."""
    masks = table_masks()
    tables = F.array(*(F.struct(F.lit(p * len(masks) + v).alias("v"), F.col("f")[p].bitwiseAND(F.lit(m)).alias("key")) for p in range(PRINTS) for v, m in enumerate(masks)))
    # The texts are small files that a few tasks would read whole, and each makes a row per table.
    texts = texts.select("t", "f").repartition(-(-max(1, texts.count()) * PRINTS * len(masks) // DEALT), "t")
    rows = texts.select("t", F.explode(tables).alias("k")).select(F.col("k.v").alias("v"), F.xxhash64("k.v", "k.key").alias("key"), "t")
    many = rows.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key")
    return rows.join(many.hint("merge"), "key", "left_semi").select("v", "key", "t")


def kin(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b) that are kin, (v, key, t) that stay in buckets of two or more), after ROUNDS pivots of each bucket."""
    alike = F.expr(f"aggregate(sequence(1, {SKETCH}), 0, (n, k) -> n + if(substring(sa, k, 1) = substring(sb, k, 1), 1, 0)) / {SKETCH}")
    x, y = (texts.select(F.col("t").alias(k), F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    found = None
    for r in range(ROUNDS):
        pivots = members.groupBy("key").agg(F.min_by("t", F.xxhash64("t", F.lit(r))).alias("b"))
        pairs = members.join(pivots.hint("merge"), "key").select("v", "key", F.col("t").alias("a"), "b").filter("a <> b")
        own = pairs.select("a", "b").distinct().join(x, "a").join(y, "b")
        own = written(own.select("a", "b", alike.alias("alike")), "alike")
        some = own.filter(F.col("alike") >= LOOSE).select("a", "b")
        found = some if found is None else found.union(some)
        stay = pairs.join(own.filter(F.col("alike") < CLOSE).select("a", "b").hint("merge"), ["a", "b"], "left_semi").select("v", "key", F.col("a").alias("t"))
        many = stay.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key")
        members = written(stay.join(many.hint("merge"), "key", "left_semi").select("v", "key", "t"), "bucket-members")
        if members.isEmpty():
            break
    return found, members


def spanning(edges: DataFrame) -> DataFrame:
    """(a, b): fewer edges that reach the same: of a's neighbours b, one a pivot and table at most, each with the least of them."""
    g = edges.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("bs"))
    return g.select(F.explode(F.concat("bs", F.array("a"))).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def similar_rows(left: list[np.ndarray], right: list[np.ndarray] | None, similar: int) -> list[tuple[int, int]]:
    """Links, as places in left + right, that span what similar pairs of left and right (of left alone without right) join."""
    sets = left if right is None else left + right
    flat = np.concatenate(sets)
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times > 1  # others are in no intersection
    place = np.cumsum(common) - 1
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    keep = common[at]
    bits = np.zeros((len(sets), max(1, -(-int(common.sum()) // 8 // 8) * 8 + 8)), dtype=np.uint8)
    np.bitwise_or.at(bits, (row[keep], place[at[keep]] >> 3), (1 << (place[at[keep]] & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)
    label, out = np.arange(len(sets)), []
    for i in range(len(left)):
        first = i + 1 if right is None else len(left)
        ok = (label[first:] != label[i]) & (np.minimum(size[first:], size[i]) * 100 >= np.maximum(size[first:], size[i]) * similar)
        for a in range(0, len(js := np.flatnonzero(ok) + first), 256):
            j = js[a : a + 256]
            both = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
            for k in j[both * 100 >= (size[i] + size[j] - both) * similar]:
                if label[k] != label[i]:
                    out.append((i, int(k)))
                    label[label == label[k]] = label[i]
    return out


def clan_links(clans: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b): links that span the similar texts of each clan; clans: (t, clan, n)."""
    of = clans.groupBy("clan").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("of"))
    d = clans.join(of.hint("merge"), "clan").withColumn("own", F.pmod(F.xxhash64("t"), F.col("of")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    d = d.join(sets.hint("merge"), "t").select("t", "clan", "own", "grams", F.explode(pair).alias("p")).select("t", "clan", "own", "grams", "p.i", "p.j")
    d = d.repartition("clan", "i", "j").sortWithinPartitions("clan", "i", "j")

    def run(batches):
        for frame in by_key(batches, ("clan", "i", "j")):
            out = []
            for (_, i, j), g in frame.groupby(["clan", "i", "j"], sort=False):
                grams = [np.asarray(x, dtype=np.int64) for x in g["grams"]]
                t, low = g["t"].to_numpy(), (g["own"] == i).to_numpy()
                order = [*np.flatnonzero(low), *np.flatnonzero(~low)]
                n = int(low.sum())
                own = [grams[k] for k in order]
                if i == j:
                    found = similar_rows(own, None, similar)
                else:
                    found = similar_rows(own[:n], own[n:], similar) if 0 < n < len(own) else []
                out += [(max(t[order[x]], t[order[y]]), min(t[order[x]], t[order[y]])) for x, y in found]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return d.mapInPandas(run, "a long, b long")


def allowed(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """(a, b), distinct: the pairs of texts that may be similar by size and fingerprints."""
    x, y = (texts.select(F.col("t").alias(k), F.col("n").alias(f"n{k}"), F.col("f").alias(f"f{k}")) for k in "ab")
    p = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().join(x, "a").join(y, "b")
    far = sum((F.bit_count(F.col("fa")[k].bitwiseXOR(F.col("fb")[k])) for k in range(PRINTS)), F.lit(0))
    return p.filter((far <= FAR) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similar)).select("a", "b")


def rest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs of each bucket's texts, each in the first table in which the two meet; members: (v, key, t)."""
    masks = np.array(table_masks(), dtype=np.int64)
    of = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of"))
    m = members.join(of.hint("merge"), "key").join(texts.select("t", "f"), "t").withColumn("own", F.pmod(F.xxhash64("t", "key"), F.col("of")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    m = m.select("v", "key", "t", "f", F.explode(pair).alias("p")).select("v", "key", "t", "f", "p.i", "p.j")
    m = m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for frame in by_key(batches, ("key", "i", "j")):
            a, b = [np.array([], dtype=np.int64)], [np.array([], dtype=np.int64)]
            for _, g in frame.groupby(["key", "i", "j"], sort=False):
                t, f, v = g["t"].to_numpy(), np.stack(g["f"].to_numpy()), int(g["v"].iloc[0])
                for k in range(len(t) - 1):
                    far = f[k + 1 :] ^ f[k]
                    met = np.zeros(len(far), dtype=bool)
                    for p in range(v // len(masks) + 1):
                        earlier = masks[: v % len(masks)] if p == v // len(masks) else masks
                        met |= ((far[:, p, None] & earlier) == 0).any(axis=1)
                    x = t[k + 1 :][~met]
                    a.append(np.maximum(x, t[k]))
                    b.append(np.minimum(x, t[k]))
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return m.mapInPandas(run, "a long, b long")


def shingle_sets(docs: DataFrame, described_docs: DataFrame, wanted: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(t, grams): the sets of the wanted texts t, each made from one of its documents."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"t": b["t"], "grams": [grams(x, shingle).view(np.int64) for x in b["text"]]})

    own = described_docs.select("id", "th", "t").join(wanted, "t", "left_semi")
    own = own.groupBy("t").agg(F.min(F.struct(F.col("id").isNull().alias("o"), "id", "th")).alias("k")).select("t", F.col("k.id").alias("i"), F.col("k.th").alias("h"))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    d = d.join(own.hint("merge"), d["id"].eqNullSafe(own["i"]) & (d["th"] == own["h"])).select("t", "text")
    out = d.mapInPandas(run, "t long, grams array<long>")
    if described_docs.groupBy("id", "th").count().filter("count > 1").limit(1).count():  # else a shuffle of sets for nothing
        out = out.dropDuplicates(["t"])
    return out


def similar_pairs(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b): the pairs whose sets have the similarity."""
    j = pairs.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return j.filter(both * 100 >= (F.size("ga") + F.size("gb") - both) * similar).select("a", "b")


def links(docs: DataFrame, d: DataFrame, id_col: str, text: str, shingle: int, similar: int = SIMILAR) -> DataFrame:
    """(a, b): each text (t) that isn't its component's smallest, with the smallest."""
    texts = written(d.filter("n > 0").groupBy("t").agg(F.first("n").alias("n"), F.first("f").alias("f"), F.first("s").alias("s")), "texts")
    related, left = kin(written(buckets(texts), "bucket-members"), texts)
    e = components(spanning(related)).toDF("t", "clan")
    clans = e.union(e.select(F.col("clan"), F.col("clan")).distinct()).join(texts.select("t", "n"), "t")
    clans = written(clans, "clans")
    own = shingle_sets(docs, d, clans.select("t"), id_col, text, shingle)
    found = written(clan_links(clans, own, similar), "similar")
    if not left.isEmpty():
        some = written(allowed(rest(left, texts), texts, similar), "candidates")
        sets = shingle_sets(docs, d, some.select(F.explode(F.array("a", "b")).alias("t")).distinct(), id_col, text, shingle)
        found = found.union(similar_pairs(some, sets, similar))
    return components(found)


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similar: int = SIMILAR) -> DataFrame:
    """(id, th, root), a row per row of docs: root is the same for all that links of similar texts reach."""
    d = written(described(docs, id_col, text, shingle), "described")
    e = links(docs, d, id_col, text, shingle, similar).toDF("t", "root")
    return d.select("id", "th", "t").join(e, "t", "left").select("id", "th", F.coalesce("root", "t").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similar: int = SIMILAR) -> DataFrame:
    """The rows of docs, with all their columns, that have their group's smallest id (null last, then text hash)."""
    return keep_least(docs, groups(docs, id_col, text, shingle, similar), id_col, text)
