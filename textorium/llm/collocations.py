"""Operator 11: phrase collocations, found by hashed bucket counts (PCY, DHP) with Apriori pruning.

The pass for phrases of k words counts exactly those whose first and last k - 1 words are frequent and whose bucket is:
each is a bit of a bitmap of BUCKETS bits, which is all that is broadcast, however large the corpus. In the same pass the
phrases of k + 1 words whose two halves were counted go to bucket counters. A bit may be set for what isn't frequent, as
phrases share buckets; that only costs a count, since a phrase is frequent by its exact count alone. With more
phrases than buckets most bits get set, and pruning is then by frequent halves only.

A task counts its own texts in chunks of bounded size, so that a phrase leaves it once a chunk, however common it is; bucket
counters leave it saturated, those above zero with their places, and are added up segment by segment in streams.

A phrase's score is the least over its cuts of 10^6 a^2 / (l r), floored, in exact decimals. A phrase inside a longer one
that has `covered` hundredths of its occurrences goes.

Cases: a null text has no words; a null group counts as `und`; a word is never empty; equal scores are put in order by count, then bytes
of the phrase; repeated rows count each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import released, written

#: Buckets of a pass and of a segment of them.
BUCKETS, SEGMENT = 1 << 26, 1 << 16
#: Words of a chunk, and distinct words after which a task's dictionary starts anew.
CHUNK, DISTINCT = 1 << 19, 1 << 18
#: Small letters for A to Z, one mark for all that ends a piece.
MARKED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)
ROWS = "lang string, phrase string, n long, segment int, counts binary"


class Words:
    """Numbers for words of a group; 0 is the end of a piece."""

    def __init__(self):
        self.names, self.groups, self.hashes, self.of = [""], [""], [0], {}
        self.counts, self.table = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def numbers(self, group: str, text: str) -> list[int]:
        d = self.of.get(group)
        if d is None:
            d = self.of[group] = _Numbered(self, group)
        return list(map(d.__getitem__, text.encode("utf-8", "surrogatepass").translate(MARKED).replace(b".", b" . ").split()))


class _Numbered(dict):
    def __init__(self, words: Words, group: str):
        super().__init__({b".": 0})
        self.words, self.group, self.salt = words, group, group.encode() + b"\0"

    def __missing__(self, w: bytes) -> int:
        at = self[w] = len(self.words.names)
        self.words.names.append(w.decode("utf-8", "surrogatepass"))
        self.words.groups.append(self.group)
        self.words.hashes.append(word_hash(self.salt, w))
        return at


def word_hash(salt: bytes, w: bytes) -> int:
    return xxhash.xxh64_intdigest(salt + w, 42)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a phrase and the word after it."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def scan(docs: DataFrame, k: int, longest: int, least: int, halves, common) -> DataFrame:
    """ROWS: partial counts of phrases of k words, and of buckets of those of k + 1. halves, common: broadcast bitmaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half, bucket = (np.frombuffer(x.value, dtype=np.uint8) if x else None for x in (halves, common))
        place = lambda h: (h >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)
        has = lambda bits, at: (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        kind = np.uint8 if least < 256 else np.uint32
        counters = np.zeros(BUCKETS, dtype=kind) if k < longest else None

        def rows(words: Words, at: list[np.ndarray], n) -> pd.DataFrame:
            names, at = words.names, [a.tolist() for a in at]
            phrase = [" ".join([names[i] for i in x]) for x in zip(*at)]
            lang = [words.groups[i] for i in at[0]]
            return pd.DataFrame({"lang": lang, "phrase": phrase, "n": n, "segment": pd.array([pd.NA] * len(n), dtype="Int32"), "counts": None})

        def counted(words: Words, ids: np.ndarray) -> pd.DataFrame | None:
            if len(ids) < k:
                return None
            if len(words.table) < len(words.hashes):
                words.table = np.array(words.hashes, dtype=np.uint64)
            single = words.table[ids]
            h, alive = single, ids != 0
            word = alive
            for j in range(1, k):
                if j == k - 1 and half is not None:
                    alive = alive & has(half, place(h))
                    both = alive[:-1] & alive[1:]
                else:
                    both = alive[:-1] & word[j:]
                h, alive = joined(h[:-1], single[j:]), both
            if k > 1:
                alive = alive & has(bucket, place(h))
            if counters is not None and len(h) > 1:
                up = np.nonzero(alive[:-1] & alive[1:])[0]
                at, n = np.unique(place(joined(h[up], single[up + k])), return_counts=True)
                counters[at] = np.minimum(counters[at] + n, least)
            p = np.nonzero(alive)[0]
            if k == 1:  # words are counted as long as the dictionary lasts
                words.counts = np.bincount(ids, minlength=len(words.names)) + np.pad(words.counts, (0, len(words.names) - len(words.counts)))
                return None
            if not len(p):
                return None
            code = ids[p].astype(np.int64)
            for j in range(1, k):
                if j > 1:
                    code = np.unique(code, return_inverse=True)[1]
                code = code << 32 | ids[p + j].astype(np.int64)
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            p = p[first]
            return rows(words, [ids[p + j] for j in range(k)], n)

        def single_words(words: Words) -> Iterator[pd.DataFrame]:
            for a in range(1, len(words.counts), CHUNK // 4):
                at = np.arange(a, min(a + CHUNK // 4, len(words.counts)))
                yield rows(words, [at], words.counts[at])

        words, held, size = Words(), [], 0
        for b in batches:
            for group, text in zip(b["lang"], b["text"]):
                held.append(np.array([*words.numbers(group, text), 0], dtype=np.int32))
                size += len(held[-1])
                if size >= CHUNK or len(words.names) >= DISTINCT:
                    if (some := counted(words, np.concatenate(held))) is not None:
                        yield some
                    held, size = [], 0
                    if len(words.names) >= DISTINCT:
                        yield from single_words(words)
                        words.of.clear()  # a dictionary knows its words: without this it would wait for the garbage collector
                        words = Words()
        if held and (last := counted(words, np.concatenate(held))) is not None:
            yield last
        yield from single_words(words)
        if counters is not None:
            parts = []
            for s in range(0, BUCKETS, SEGMENT):
                if len(at := np.flatnonzero(counters[s : s + SEGMENT])):
                    parts.append((s // SEGMENT, at.astype(np.uint16).tobytes() + counters[s + at].tobytes()))
            if parts:
                yield pd.DataFrame({"lang": None, "phrase": None, "n": pd.array([pd.NA] * len(parts), dtype="Int64"), "segment": [s for s, _ in parts], "counts": [c for _, c in parts]})

    return written(docs.mapInPandas(run, ROWS), f"phrases-{k}", "zstd")


def _packed(bits: dict[int, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"segment": list(bits), "bits": [np.packbits(b, bitorder="little").tobytes() for b in bits.values()]})


def _bitmap(segments: DataFrame, run) -> bytes:
    """BUCKETS bits from the segments that run makes of rows dealt by segment."""
    out = np.zeros(BUCKETS // 8, dtype=np.uint8)
    for s, bits in segments.repartition("segment").mapInPandas(run, "segment int, bits binary").collect():
        out[s * SEGMENT // 8 : (s + 1) * SEGMENT // 8] = np.frombuffer(bits, dtype=np.uint8)
    return out.tobytes()


def common_buckets(scanned: DataFrame, least: int) -> bytes:
    """The bitmap of the buckets that reach the least count, however many tasks counted."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b["segment"], b["counts"]):
                n = len(c) // (2 + kind().itemsize)
                at, more = np.frombuffer(c, dtype=np.uint16, count=n), np.frombuffer(c, dtype=kind, offset=2 * n)
                own = total.setdefault(s, np.zeros(SEGMENT, dtype=kind))
                own[at] = np.minimum(own[at].astype(np.uint64) + more, least)
        yield _packed({s: c >= least for s, c in total.items()})

    return _bitmap(scanned.filter("segment is not null").select("segment", "counts"), run)


def phrase_buckets(phrases: DataFrame) -> bytes:
    """The bitmap of the buckets of phrases, all of one length."""

    def placed(batches):
        for b in batches:
            salts = [g.encode() + b"\0" for g in b["lang"]]
            h = None
            for w in zip(*(p.encode("utf-8", "surrogatepass").split(b" ") for p in b["phrase"])):
                own = np.array([word_hash(s, x) for s, x in zip(salts, w)], dtype=np.uint64)
                h = own if h is None else joined(h, own)
            if h is not None:
                at = (h >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)
                yield pd.DataFrame({"segment": at // SEGMENT, "at": at % SEGMENT})

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, at in b.groupby("segment")["at"]:
                total.setdefault(s, np.zeros(SEGMENT, dtype=bool))[at.to_numpy()] = True
        yield _packed(total)

    return _bitmap(phrases.select("lang", "phrase").mapInPandas(placed, "segment int, at int"), run)


def frequent(scanned: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n): the phrases of the least count."""
    d = scanned.filter("segment is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return written(d.filter(F.col("n") >= least), "frequent")


def counts(docs: DataFrame, text: str = "text", group: str = "lang", longest: int = 3, least: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length (lang, phrase, n) of the frequent phrases."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    out, halves, common, totals = [], None, None, None
    for k in range(1, longest + 1):
        scanned = scan(docs, k, longest, least, halves, common)
        if k == 1:
            totals = written(scanned.filter("segment is null").groupBy("lang").agg(F.sum("n").alias("n")), "words-by-group")
        out.append(frequent(scanned, least))
        if k < longest:
            halves, common = (spark.sparkContext.broadcast(x) for x in (phrase_buckets(out[-1]), common_buckets(scanned, least)))
        released(scanned)
    return totals, out


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each group's `top` phrases of 2 to `longest` words."""
    totals, by_length = counts(docs, text, group, longest, least)
    union = lambda ds: ds[0] if len(ds) == 1 else ds[0].unionByName(union(ds[1:]))
    f = union(by_length[:-1]).select("lang", "phrase", "n")
    c = union(by_length[1:]).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = c.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("x"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("y"))
    cuts = cuts.join(f.toDF("lang", "x", "l"), ["lang", "x"]).join(f.toDF("lang", "y", "r"), ["lang", "y"])
    exact = lambda *xs: " * ".join(f"cast({x} as decimal(15, 0))" for x in xs)
    cuts = cuts.withColumn("score", F.expr(f"({exact('a', 'a')} * 1000000) div ({exact('l', 'r')})"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b")).select("lang", "phrase", "b.*")
    if longest > 2:
        long = c.filter(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("s"))
        long = long.select("lang", "a", "w", "s", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("s") + 1)).alias("i"))
        inside = long.select("lang", part(F.col("i"), F.col("s")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        scored = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3)) t(k))),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cuts AS (
  SELECT lang, phrase, c AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
scored AS (
  SELECT u.lang, u.phrase, u.a, u.cut, x.c AS l, y.c AS r, ((1000000::HUGEINT * u.a * u.a) // (x.c::HUGEINT * y.c))::BIGINT AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(list_slice(u.w, 1, u.cut), ' ')
  JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(list_slice(u.w, u.cut + 1, len(u.w)), ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(c) AS longer FROM (
    SELECT lang, c, array_to_string(list_slice(string_split(phrase, ' '), i, i + 1), ' ') AS phrase FROM f, (VALUES (1), (2)) t(i) WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT least.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
