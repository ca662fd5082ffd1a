"""Operator 10: removal of repeated 50-byte strings with suffix arrays.

A byte goes if a 50-byte string over it also starts in a document with a smaller id. Equal strings must meet in one
shard for that, so strings are dealt by anchors: of the 24-byte grams in every 50-byte string the one with the least
hash, which equal strings share at the same place. An anchor's context is all that its own 50-byte strings
reach, 76 bytes at most; one that comes back within its document is one row, and its places are looked up again at the
end. Anchors whose gram stands in one document only are done with. Of equal contexts only the one
with the smallest id is compared further: every later one loses all its strings. The contexts that are left and
differ around the same gram go to shards, whose suffix arrays come from induced sorting: suffixes are classified,
leftmost-smaller substrings are sorted by inducing and named, names that recur are ranked by doubling, and the whole array is induced
from them, all bucket by bucket in numpy; common prefixes are computed in text order against each suffix's
predecessor. Suffixes with 50 bytes or more in common form a run, and a run's smallest id decides.

A key with more than LARGE different contexts is split into further shards: the strings around its gram are told apart by
where the gram stands in them, in ranges of 9, then 3, then 1 places, and a range's key is what all its strings
share, 42, 48 and at last all 50 bytes. Equal pieces become one again, by their bytes, before a key is looked at.

Cases: null text is empty; null ids neither lose bytes nor make others lose any; ids of any ordered type do; rows with the same id don't
affect each other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SPAN = 50
GRAM = 24
REACH = SPAN - GRAM
SHARD_CONTEXTS = 24_000
LARGE = SHARD_CONTEXTS // 2
#: Places of the gram in a string that share a key, level by level.
WIDTHS = (9, 3, 1)
#: Bytes of texts that are looked at side by side.
PIECE = 1 << 17
UPPER = np.uint64(0xFFFFFFFF00000000)

_g = np.random.default_rng(20)
TABLE = _g.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = _g.integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _slid(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Anchors of texts: gram hash h, context hash c, number of the text, start lo and length n of the context, pre: bytes of it before the gram."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(raw) < SPAN:
        return {k: np.empty(0, dtype=t) for k, t in (("h", np.uint64), ("c", np.uint64), ("text", np.int64), ("lo", np.int64), ("n", np.int64), ("pre", np.int64))}
    x = TABLE[raw]
    for k, step in enumerate(STEPS):
        eight = x if k == 3 else None if k < 3 else eight
        x = x[: -(1 << k)] * step + x[1 << k :]
    sixteen = x  # of 16 bytes, from those of 8
    h = _mixed(sixteen[: len(raw) - GRAM + 1] * STEPS[0] + eight[16 : 16 + len(raw) - GRAM + 1])
    # The leftmost of a string's grams with the least upper half of the hash: half and place make one number.
    at = (h & UPPER) | np.arange(len(h), dtype=np.uint64)
    of = (_slid(at, REACH + 1) & ~UPPER).astype(np.int64)  # the gram of each string
    inside = np.zeros(len(raw) + 1, dtype=np.int64)  # strings that end within their text
    good = lengths >= SPAN
    np.add.at(inside, (ends - lengths)[good], 1)
    np.add.at(inside, (ends - SPAN + 1)[good], -1)
    s = np.nonzero(np.cumsum(inside)[: len(of)] > 0)[0]
    of = of[s]
    head = np.append(True, of[1:] != of[:-1]) if len(of) else np.empty(0, dtype=bool)  # a gram's strings are neighbours
    p, lo = of[head], s[head]
    hi = s[np.append(np.nonzero(head)[0][1:], len(s)) - 1] + SPAN if len(s) else lo
    text = np.searchsorted(ends, p, side="right")
    first = (ends - lengths)[text]
    c = ((p - lo) * 256 + (hi - p)).astype(np.uint64)
    for k in range(-(-(GRAM + 2 * REACH) // 16)):  # 16-byte hashes that cover the context between them
        c = _mixed(c * STEPS[1] + sixteen[np.minimum(lo + 16 * k, hi - 16)])
    return {"h": h[p], "c": c, "text": text, "lo": lo - first, "n": hi - lo, "pre": p - lo}


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of t, whose values are below k and whose last is the only 0, by induced sorting."""
    n = len(t)
    t = t.astype(np.uint16)
    step = np.sign(np.diff(t.astype(np.int32)))
    far = np.where(step != 0, np.arange(n - 1), n - 1)
    far = np.minimum.accumulate(far[::-1])[::-1]
    small = np.append(np.append(step, 1)[far] > 0, True)  # smaller than its successor
    lms = np.nonzero(small[1:] & ~small[:-1])[0] + 1

    def induced(order: np.ndarray) -> np.ndarray:
        """All suffixes, larger ones from the ordered leftmost-smaller ones, then smaller ones from the larger."""

        def deal(pos, queues, want):
            prev = pos - 1
            prev = prev[(small[prev] == want) & (prev >= 0)]
            if not len(prev):
                return
            ch = t[prev]
            turn = ch.argsort(kind="stable")
            prev, ch = prev[turn], ch[turn]
            cuts = (np.flatnonzero(ch[1:] != ch[:-1]) + 1).tolist()
            names = ch[[0, *cuts]].tolist()
            for c, a, b in zip(names, [0, *cuts], [*cuts, len(prev)]):
                queues[c].append(prev[a:b])

        of = t[order]
        turn = np.argsort(of, kind="stable")
        by = np.split(order[turn], np.searchsorted(of[turn], np.arange(1, k)))
        none = np.empty(0, dtype=np.int64)
        large: list = [[] for _ in range(k)]
        for c in range(k):
            i = 0
            while i < len(large[c]):
                deal(large[c][i], large, False)
                i += 1
            if len(by[c]):
                deal(by[c], large, False)
            large[c] = np.concatenate(large[c]) if large[c] else none
        less: list = [[] for _ in range(k)]
        for c in range(k - 1, -1, -1):
            i = 0
            while i < len(less[c]):
                deal(less[c][i], less, True)
                i += 1
            if len(large[c]):
                deal(large[c][::-1], less, True)
            less[c] = np.concatenate(less[c])[::-1] if less[c] else none
        less[0] = np.array([n - 1])
        return np.concatenate([x for c in range(k) for x in (large[c], less[c])])

    if len(lms) > 1:
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        once = induced(lms)
        once = once[is_lms[once]]
        end = np.empty(n, dtype=np.int64)
        end[lms] = np.append(lms[1:], n - 1)
        a, b = once[:-1], once[1:]
        same = (end[a] - a == end[b] - b) & (b != n - 1) & (a != n - 1)
        length = end[a] - a
        alive, off = np.nonzero(same)[0], 0
        while len(alive):
            good = t[a[alive] + off] == t[b[alive] + off]
            same[alive[~good]] = False
            alive = alive[good]
            alive = alive[length[alive] > off]
            off += 1
        name = np.empty(n, dtype=np.int64)
        name[once] = np.concatenate([[0], np.cumsum(~same)])
        rank, reach = name[lms], 1
        while rank.max() < len(rank) - 1:  # names recur: rank pairs of neighbours, pairs of pairs, ...
            ahead = np.zeros(len(rank), dtype=np.int64)
            ahead[:-reach] = rank[reach:] + 1
            _, rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)
            reach *= 2
        order = np.empty(len(lms), dtype=np.int64)
        order[rank] = lms
        lms = order
    return induced(lms)


def repeated_strings(parts: list[bytes], owners: np.ndarray, span: int = SPAN) -> list[np.ndarray]:
    """For each part, where a string of `span` bytes starts that also stands in a part with a smaller owner."""
    if not parts:
        return []
    lengths = np.array([len(p) for p in parts])
    flat = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    t = flat.astype(np.int32) + 2
    t[starts + lengths] = 1
    t = np.append(t, 0)
    sa = suffix_array(t, 258)
    part = np.repeat(np.arange(len(parts)), lengths + 1)
    left = starts[part] + lengths[part] - np.arange(len(flat))  # bytes to the part's end
    before = np.full(len(t), -1)
    before[sa[1:]] = sa[:-1]
    common = np.zeros(len(t), dtype=np.int64)  # in text order, up to span
    alive = np.nonzero(left >= span)[0]
    alive = alive[before[alive] < len(flat)]
    alive = alive[left[before[alive]] >= span]
    for k in range(span):
        alive = alive[t[alive + k] == t[before[alive] + k]]
        common[alive] = k + 1
    whole = sa[(sa < len(flat))]
    whole = whole[left[whole] >= span]
    if not len(whole):
        return [np.empty(0, dtype=np.int64) for _ in parts]
    run = np.cumsum(common[whole] < span)
    own = owners[part[whole]]
    heads = np.nonzero(np.diff(run, prepend=run[0] - 1))[0]
    least = np.minimum.reduceat(own, heads)[run - run[0]]
    hit = np.sort(whole[least < own])
    return [hit[a:b] - s for s, a, b in zip(starts, np.searchsorted(hit, starts), np.searchsorted(hit, starts + lengths))]


def _runs(starts: np.ndarray, span: int = SPAN) -> list[tuple[int, int]]:
    cuts = np.nonzero(np.diff(starts) > span)[0] + 1
    return [(int(x[0]), int(x[-1]) + span) for x in np.split(starts, cuts) if len(x)]


def _released(spark) -> None:
    """Lets Spark delete the shuffle files of steps that are done and written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def split(rows: DataFrame, width: int) -> DataFrame:
    """The rows' strings by ranges of `width` places of the gram: a row per range that the row has strings of."""
    low, high = f"greatest(g * {width}, pre - length(part) + {SPAN})", f"least(g * {width} + {width - 1}, pre)"
    ranges = F.expr(
        f"transform(sequence(cast((pre - length(part) + {SPAN}) / {width} as int), cast(pre / {width} as int)), g -> struct("
        f"xxhash64(key, g, substring(part, pre - g * {width} + 1, {SPAN - width + 1})) as key, {high} - {low} + {SPAN} as size, pre - {high} as skip, {high} as pre))"
    )
    d = rows.select("id", "th", "h", "c", "lo", "more", "off", "part", F.explode(ranges).alias("x"))
    part = F.expr("substring(part, x.skip + 1, x.size)")
    return d.select("id", "th", "h", "c", "lo", "more", (F.col("off") + F.col("x.skip")).alias("off"), part.alias("part"), F.col("x.key").alias("key"), F.col("x.pre").alias("pre"))


def settled(rows: DataFrame) -> DataFrame:
    """The rows of keys with two ids or more, and: whole, an equal piece stands under a smaller id; large, the key has too many pieces."""
    firsts = rows.groupBy("key", "part").agg(F.min("id").alias("first"))
    keys = firsts.groupBy("key").agg(F.min("first").alias("low"), F.max("first").alias("last"), F.count("*").alias("own"))
    d = rows.join(firsts, ["key", "part"]).join(keys, "key").withColumn("whole", F.col("id") > F.col("first"))
    d = d.filter("whole or low < last").withColumn("large", F.col("own") > LARGE)
    return d.drop("first", "low", "last", "own")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, spans): what `ranges` turns into byte ranges to remove, for each document that loses some."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    twice = d.groupBy("id").count().filter("count > 1").limit(1).count()
    d = d.withColumn("th", F.xxhash64("text") if twice else F.lit(0).cast("long"))

    def anchored(batches):
        for b in batches:
            raws = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            ids, ths = b["id"].to_numpy(), b["th"].to_numpy()
            at = 0
            while at < len(raws):
                end, held = at, 0
                while end < len(raws) and (end == at or held < PIECE):
                    held += len(raws[end])
                    end += 1
                found = anchors(raws[at:end])
                if len(found["h"]):
                    # a context that comes back in its text is one row, marked
                    order = np.lexsort((found["lo"], found["c"], found["h"], found["text"]))
                    h, c, t = found["h"][order], found["c"][order], found["text"][order]
                    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (t[1:] != t[:-1]))
                    more = np.append(~new[1:], False)[new]
                    pick = order[new]
                    packed = (((found["lo"][pick] * 128 + found["n"][pick]) * 32 + found["pre"][pick]) * 2 + more).astype(np.int64)
                    of = at + found["text"][pick]
                    yield pd.DataFrame({"h": found["h"][pick].view(np.int64), "c": found["c"][pick].view(np.int64), "id": ids[of], "th": ths[of], "at": packed})
                at = end

    a = d.mapInPandas(anchored, f"h long, c long, id {kind}, th long, at long")
    gram, context = W.partitionBy("h"), W.partitionBy("h", "c")
    a = a.withColumn("first", F.min("id").over(context)).withColumn("low", F.min("id").over(gram)).withColumn("high", F.max("id").over(gram))
    a = a.filter("low < high").withColumn("own", F.sum(F.when(F.col("id") == F.col("first"), 1).otherwise(0)).over(gram)).withColumn("last", F.max("first").over(gram))
    a = a.select(
        "h", "c", "id", "th", F.shiftright("at", 13).alias("lo"), F.shiftright("at", 6).bitwiseAND(127).alias("n"), F.shiftright("at", 1).bitwiseAND(31).alias("pre"),
        (F.col("at").bitwiseAND(1) == 1).alias("more"), (F.col("id") > F.col("first")).alias("whole"), (F.col("low") < F.col("last")).alias("mixed"), (F.col("own") > LARGE).alias("large"),
    )
    a = written(a, "anchors")
    _released(spark)

    reps = a.filter("mixed and not whole")
    by_doc = reps.groupBy(F.col("id").alias("i"), F.col("th").alias("x")).agg(F.collect_list(F.struct("h", "c", "lo", "n", "pre", "more", "large")).alias("cuts"))

    def cut(batches):
        for b in batches:
            rows = []
            for i, th, s, cuts in zip(b["id"], b["th"], b["text"], b["cuts"]):
                raw = s.encode("utf-8", "surrogatepass")
                rows += [(x["h"], x["h"], x["c"], i, th, x["lo"], 0, x["pre"], raw[x["lo"] : x["lo"] + x["n"]], x["more"], x["large"]) for x in cuts]
            yield pd.DataFrame(rows, columns=["key", "h", "c", "id", "th", "lo", "off", "pre", "part", "more", "large"])

    parts = d.join(by_doc.hint("merge"), d["id"].eqNullSafe(by_doc["i"]) & (d["th"] == by_doc["x"])).select("id", "th", "text", "cuts")
    parts = written(parts.mapInPandas(cut, f"key long, h long, c long, id {kind}, th long, lo long, off long, pre long, part binary, more boolean, large boolean"), "contexts")
    _released(spark)

    of = ["id", "th", "h", "c", "lo", "more"]

    def shard(batches):
        b = pd.concat(list(batches) or [pd.DataFrame()])  # a shard of about SHARD_CONTEXTS contexts
        if not len(b):
            return
        owners = np.unique(b["id"].to_numpy(), return_inverse=True)[1]
        hits = repeated_strings([bytes(x) for x in b["part"]], owners)
        rows = [(*r, o + s, o + e) for *r, o, x in zip(b["id"], b["th"], b["h"], b["c"], b["lo"], b["more"], b["off"], hits) for s, e in _runs(x)]
        yield pd.DataFrame(rows, columns=[*of, "a", "b"])

    every = a.filter("whole").select(*of, F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b"))
    small = [parts.filter("not large")]
    large = parts.filter("large")
    for width in WIDTHS:
        if not large.limit(1).count():
            break
        level = written(settled(split(large, width)), "pieces")
        every = every.unionByName(level.filter("whole").select(*of, F.col("off").alias("a"), (F.col("off") + F.length("part")).alias("b")))
        small.append(level.filter("not whole and not large"))
        large = level.filter("not whole and large")
    cold = reduce(DataFrame.unionByName, [x.select("key", *of, "off", "part") for x in small])
    shards = max(1, -(-cold.count() // SHARD_CONTEXTS))
    every = every.unionByName(cold.repartition(shards, "key").mapInPandas(shard, f"id {kind}, th long, h long, c long, lo long, more boolean, a long, b long"))
    # Hashes only matter where a context stands at several places; no field is null, so that none turns into a float.
    mark = lambda c: F.when(F.col("more"), F.col(c)).otherwise(0)
    span = F.struct((F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"), "more", mark("h").alias("h"), mark("c").alias("c"), "a", "b")
    return every.groupBy("id", "th").agg(F.collect_list(span).alias("spans"))


def ranges(raw: bytes, spans) -> list[tuple[int, int]]:
    """Byte ranges of the spans of one text; marked ones at every place where their context stands."""
    out = [(x["lo"], x["hi"]) for x in spans]
    again: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x in spans:
        if x["more"]:
            again.setdefault((x["h"], x["c"]), []).append((x["a"], x["b"]))
    if again:
        found = anchors([raw])
        for h, c, lo in zip(found["h"].view(np.int64).tolist(), found["c"].view(np.int64).tolist(), found["lo"].tolist()):
            out += [(lo + a, lo + b) for a, b in again.get((h, c), ())]
    return out


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of sorted or unsorted ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept), a row per row of docs.

    removed: the maximal runs as (lo, hi); kept: what is left, null unless keep_bytes.
    """
    gone = written(repeated_spans(docs, id_col, text), "spans").withColumnsRenamed({"id": "i", "th": "x"})
    _released(docs.sparkSession)
    twice = gone.filter("x <> 0").limit(1).count()
    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), (F.xxhash64(text) if twice else F.lit(0).cast("long")).alias("th"))
    d = d.join(gone.hint("merge"), (d["id"] == gone["i"]) & (d["th"] == gone["x"]), "left").select("id", "text", "spans")

    def run(batches):
        for b in batches:
            rows = []
            for i, s, spans in zip(b["id"], b["text"], b["spans"]):
                raw = s.encode("utf-8", "surrogatepass") if isinstance(s, str) else b""
                cuts = merged(ranges(raw, spans)) if spans is not None else []
                kept, at = [], 0
                for lo, hi in cuts:
                    kept.append(raw[at:lo])
                    at = hi
                left = b"".join([*kept, raw[at:]])
                rows.append((i, len(raw), len(raw) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), [{"lo": a, "hi": b} for a, b in cuts], left if keep_bytes else None))
            out = pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])
            out["id"] = b["id"].to_numpy()
            yield out

    kind = d.schema["id"].dataType.simpleString()
    out = d.mapInPandas(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<lo:long,hi:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
