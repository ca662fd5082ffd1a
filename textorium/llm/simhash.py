"""Operator 9: SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints: bit majorities over the XXH64 of word shingles. Every bit position gets a non-zero vector of radius + 1
bits; table v (each non-zero vector) keeps the positions whose vector has an odd product with v. Any `radius`
positions leave some v with even products for all of them, so two fingerprints within the radius agree on all
that some table keeps: no pair within the radius is missed.

Equal fingerprints are one row before anything is compared, so that copies are never paired. A bucket's members are
dealt to blocks of about BLOCK distinct fingerprints, one block for most buckets, and a task holds two blocks at a
time: it compares pair by pair, or, once there are more members than a fingerprint has neighbours, by looking all
neighbours up; only spanning links leave it. Components
come from alternating large and small stars, each round written to the shared folder.

Cases: a null or empty text has fingerprint 0, linked like any other; null ids take part but name a component only
if it has no other id (then it is null); repeated rows get the same answer; an empty table gives an empty result;
other columns of the input are ignored by `near_duplicates`.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BITS = 64
#: Rows of a block of pairs that are compared at once.
FEW = 256
#: Members of a block of a bucket.
BLOCK = 1 << 13
#: Rows that a task deals to the tables' buckets.
DEALT = 1 << 20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64 (seed 42); the whole sequence if there are fewer words, 0 for none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, 42) for g in grams), dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def covering_masks(radius: int) -> list[int]:
    """2^(radius + 1) - 1 masks that keep 32 bits or more each, for a radius of 6 at most.

    Positions take the non-zero vectors in turn; at radius 6, where these outnumber the positions, the 64 with the
    top bit, whose products with any other vector are odd for exactly half.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius from 0 to 6")
    tables = (1 << radius + 1) - 1
    vectors = [64 + i if radius == 6 else i % tables + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() & 1) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, th, fp), a row per row of docs; th tells texts apart; no shuffle."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "th": b["th"], "fp": np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"id {kind}, th long, fp long")


def bucket_links(members: np.ndarray, mask: int, radius: int) -> list[tuple[int, int]]:
    """Spanning links (larger, smaller) of the members of one bucket, which all agree under the mask."""
    a = np.unique(members.view(np.uint64))
    n = len(a)
    label = np.arange(n)

    def join(i, j):
        nonlocal label
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, label[i], low)
            np.minimum.at(new, label[j], low)
            new = new[new]
            if (new == label).all():
                return
            label = new

    free = [1 << b for b in range(BITS) if not mask >> b & 1]
    if n <= max(FEW, sum(comb(len(free), k) for k in range(1, radius + 1))):
        for at in range(0, n, FEW):
            i, j = np.nonzero(np.bitwise_count(a[at : at + FEW, None] ^ a[None, at:]) <= radius)
            i, j = i[i < j] + at, j[i < j] + at
            if len(i):
                join(i, j)
    else:
        for k in range(1, radius + 1):
            for flips in combinations(free, k):
                other = a ^ np.uint64(sum(flips))
                at = np.minimum(np.searchsorted(a, other), n - 1)
                i = np.nonzero((a[at] == other) & (at > np.arange(n)))[0]
                if len(i):
                    join(i, at[i])
    while (label != label[label]).any():
        label = label[label]
    signed = a.view(np.int64)
    return [(int(signed[i]), int(signed[label[i]])) for i in range(n) if label[i] != i]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that span every group of the distinct fingerprints `fp` within the radius of one another."""
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks)))
    # The distinct fingerprints are a small file that a few tasks would read whole, and each makes a row per table.
    fps = fps.select("fp").repartition(-(-max(1, fps.count()) * len(masks) // DEALT), "fp")
    rows = fps.select("fp", F.explode(tables).alias("t")).select("t.v", "t.key", "fp")
    many = written(rows.groupBy("v", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    # A member goes to every pair of blocks that its own is in.
    rows = rows.join(many.hint("merge"), ["v", "key"]).withColumn("of", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("of")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    rows = rows.select("v", "key", "fp", F.explode(pair).alias("p"))
    buckets = rows.groupBy("v", "key", "p.i", "p.j").agg(F.collect_list("fp").alias("fps"))

    def run(batches):
        for b in batches:
            out = [x for v, f in zip(b["v"], b["fps"]) for x in bucket_links(np.asarray(f, dtype=np.int64), masks[v], radius)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return buckets.filter(F.size("fps") > 1).select("v", "fps").mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that isn't its component's smallest, with the smallest.

    Rounds of large stars (larger neighbours move to the smallest neighbour) and small stars (smaller ones do) until
    nothing changes; a round needs counts by node and joins on it only, whose hot nodes Spark splits.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = written(small.select("x.a", "x.b").filter("a <> b").distinct(), "stars")
        now = state(e)
        if now == before:
            break
        before = now
    return e


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, th, fp, root, component), a row per row of docs: root is the group's smallest fingerprint."""
    d = written(fingerprints(docs, id_col, text, shingle), "fingerprints")
    fps = written(d.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    e = components(links(fps, radius)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    linked = fps.join(e, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "root", "component")
    return d.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component), a row per row of docs: component is the smallest id that links reach."""
    return groups(docs, id_col, text, shingle, radius).select(F.col("id").alias(id_col), "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs, with all their columns, that have their group's smallest id (null last, then text hash)."""
    return keep_least(docs, groups(docs, id_col, text, shingle, radius), id_col, text)


def keep_least(docs: DataFrame, grouped: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of docs that have the smallest id of their root in grouped (id, th, root)."""
    g = written(grouped.select("id", "th", "root"), "groups")
    best = g.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("o"), "id", "th")).alias("k"))
    best = written(best.select(F.col("k.id").alias("_own_id"), F.col("k.th").alias("_own_th")), "kept")
    d = docs.withColumn("_own_h", F.xxhash64(text))
    d = d.join(best.hint("merge"), d[id_col].eqNullSafe(best["_own_id"]) & (d["_own_h"] == best["_own_th"]), "left_semi")
    if g.groupBy("id", "th").count().filter("count > 1").limit(1).count():  # else a shuffle of texts for nothing
        d = d.dropDuplicates([id_col, "_own_h"])
    return d.drop("_own_h")
