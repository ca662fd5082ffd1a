"""The pipeline's near copies against all pairs: no false merge, every pair within the covered radius, recall of the rest."""

from __future__ import annotations

from itertools import combinations

import numpy as np

import corpus_pipeline
from textorium.llm import near_texts

from .test_operators import prose, table


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def texts():
    """Copies with spread and with blocked changes, just over and just under the similarity, and a large group."""
    out, g = [], np.random.default_rng(5)
    for k in range(60):
        w = prose(900 + k, 200).split()
        out.append(" ".join(w))
        for share in (0.015, 0.02, 0.03):
            c = list(w)
            for i in g.choice(len(w), int(share * len(w)), replace=False):
                c[i] = f"changed{i}"
            out.append(" ".join(c))
        for n in (15, 17, 19, 24, 60):
            out.append(" ".join(w[:90] + [f"block{i}" for i in range(n)] + w[90 + n :]))
    w = prose(990, 150).split()
    for k in range(70):
        out.append(" ".join([*w[: k % 9], f"own{k}", f"own{k}", *w[k % 9 + 2 :]]))
    return [*out, None, "", " ", "one", "One ", "one two", *[prose(991, 100)] * 3]


def test_near_copies_all_pairs(spark):
    t = texts()
    rows = [(len(t) - i, x, "en", "s") for i, x in enumerate(t)]
    s, root = [shingles(x) for x in t], list(range(len(t)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = [(i, j) for i, j in combinations(range(len(t)), 2) if similar(s[i], s[j])]
    assert sum(len(s[i] & s[j]) / max(1, len(s[i] | s[j])) < 0.85 for i, j in linked) > 100
    for i, j in linked:
        root[top(i)] = top(j)
    d = table(spark, rows)
    own = {r.id: r.root for r in near_texts.groups(d).collect()}
    of = [own[r[0]] for r in rows]
    # no false merge: what ours joins is joined by links of similar texts
    exact = {}
    for i in range(len(t)):
        exact.setdefault(of[i], set()).add(top(i))
    assert all(len(x) == 1 for x in exact.values())
    # every similar pair within the covered radius of one fingerprint is joined, and nearly all others are
    f = [near_texts.prints(x) for x in t]
    within = [(i, j) for i, j in linked if min((x ^ y).bit_count() for x, y in zip(f[i], f[j])) <= near_texts.RADIUS and sum((x ^ y).bit_count() for x, y in zip(f[i], f[j])) <= near_texts.FAR]
    assert len(within) > 1000 and all(of[i] == of[j] for i, j in within)
    assert sum(of[i] == of[j] for i, j in linked) >= 0.98 * len(linked)
    # one document of each group stays: the least id
    least = {}
    for x, r in zip(of, rows):
        least[x] = min(least.get(x, len(t)), r[0])
    got = corpus_pipeline.near_copies(spark, d, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(least.values())


def test_blocks_of_large_buckets(spark, monkeypatch):
    """Blocks of two members find the same groups as whole buckets."""
    t = texts()[:200]
    d = table(spark, [(i, x, "en", "s") for i, x in enumerate(t)])

    def groups():
        by = {}
        for r in near_texts.groups(d).collect():
            by.setdefault(r.root, set()).add(r.id)
        return sorted(map(sorted, by.values()))

    want = groups()
    monkeypatch.setattr(near_texts, "BLOCK", 2)
    assert groups() == want


def test_near_copies_empty(spark):
    d = table(spark, [(1, "a b", "en", "s")])
    assert near_texts.keep_one(d.filter("false")).count() == 0
    assert near_texts.keep_one(d.union(d)).count() == 1


def test_rows_of_a_large_group_of_half_similar_texts_are_linear(spark, tmp_path):
    """Nothing but pairs with pivots and spanning links leaves a block, however many of a group's pairs nearly are similar."""
    from pyspark.sql import functions as F

    def rows(n):
        g, w = np.random.default_rng(n), prose(995, 200).split()
        t = []
        for k in range(n):
            c = list(w)
            for i in g.choice(len(w), int(g.integers(2, 30)), replace=False):
                c[i] = f"own{k}x{i}"
            t.append(" ".join(c))
        docs = table(spark, [(i, x, "en", "s") for i, x in enumerate(t)])
        d = near_texts.written(near_texts.described(docs, "doc_id", "text", 5), "d")
        texts = near_texts.written(d.groupBy("t").agg(F.first("n").alias("n"), F.first("f").alias("f"), F.first("s").alias("s")), "t")
        related, left = near_texts.kin(near_texts.written(near_texts.buckets(texts), "m"), texts)
        clans = related.select(F.explode(F.array("a", "b")).alias("t")).distinct().withColumn("clan", F.lit(0)).join(texts.select("t", "n"), "t")
        sets = near_texts.shingle_sets(docs, d, clans.select("t"), "doc_id", "text", 5)
        return related.distinct().count(), near_texts.clan_links(clans, sets, 80).count(), near_texts.rest(left, texts).count()

    related, found, left = rows(600)
    most = 600 * near_texts.ROUNDS * near_texts.PRINTS * len(near_texts.table_masks())  # a member meets a pivot a table and round
    assert found < 600 and related <= most and related < 600 * 599 / 2 / 8 and left < 600 * 599 / 2 / 50


def test_similar_rows_against_all_pairs():
    g = np.random.default_rng(9)
    for case in range(40):
        base = g.integers(0, 60, 40)
        sets = [np.unique(np.where(g.random(40) < g.choice([0.02, 0.1, 0.5]), g.integers(0, 500, 40), base)) for _ in range(14)] + [np.array([7]), np.array([7])]
        k = len(sets) if case % 2 else 6
        found = near_texts.similar_rows(sets[:k], sets[k:] or None, 80)
        pairs = [(i, j) for i in range(k) for j in (range(i + 1, k) if k == len(sets) else range(k, len(sets)))]
        want = [(i, j) for i, j in pairs if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        assert set(found) <= set(want)

        def parts(links):
            root = list(range(len(sets)))
            for a, b in links * len(sets):
                root[a] = root[b] = min(root[a], root[b])
            return root

        assert parts(found) == parts(want)
