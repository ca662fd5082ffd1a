"""Operators 11 to 13 against versions written out plainly."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from textorium.llm import collocations, language_model, merkle

from .test_operators import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long, first string, g string, hash string"


def table(spark, rows):
    """With columns that have names of the operators' own."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


# 13


def H(*x):
    return sha256("".join(x).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout):
    """(root, siblings of each leaf)"""
    paths, now, below = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(now) > 1:
        up, kids = [], []
        for k in range(0, len(now), fanout):
            run = now[k : k + fanout]
            for x in range(len(run)):
                for i in below[k + x]:
                    paths[i] += run[:x] + run[x + 1 :]
            up.append(H(*run))
            kids.append(sum(below[k : k + fanout], []))
        now, below = up, kids
    return now[0], paths


def manifest(rows, fanout):
    by = {}
    for i, text, lang, source, n in rows:
        by.setdefault(lang, []).append(((i is not None, i or 0), leaf(i, source, lang, n, text), i, n))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs, paths = [], []
    for x in langs:
        by[x].sort(key=lambda r: r[:2])
        s, p = tree([r[1] for r in by[x]], fanout)
        subs.append(s)
        paths.append(p)
    root, tops = tree(subs, fanout)
    out = []
    for k, x in enumerate(langs):
        for r, p in zip(by[x], paths[k]):
            broken = r[2] is not None and r[3] is not None and crc32(str(r[2]).encode()) % 7 == 0
            out.append((r[2], r[1], subs[k], root, H(*p, *tops[k]), not broken))
    return sorted(out, key=str)


def some_rows(n, seed=1):
    g = random.Random(seed)
    rows = [(i, f"text {i} ü", g.choice(["en", "en", "en", "de", "é", None]), g.choice(["s", None]), g.choice([i, None])) for i in g.sample(range(10 * n), n)]
    return rows + [rows[0]] * 3 + [(None, None, None, None, None)] * 2 + [(None, "", "lone", "", 0), (rows[1][0], "same id", rows[1][2], None, 5)]


@pytest.mark.parametrize("fanout,tile", [(2, 10), (2, 2), (3, 1)])
def test_manifest(spark, fanout, tile, monkeypatch):
    monkeypatch.setattr(merkle, "TILE", tile)
    rows = some_rows(230)
    got = merkle.verified(table(spark, rows).repartition(5), fanout=fanout)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.p, r.verified) for r in got.withColumn("p", F.sha2(merkle.proof(F.col("path")), 256)).collect()]
    assert sorted(got, key=str) == manifest(rows, fanout)


def test_mountains_merge_whatever_the_cuts():
    """Runs cut anywhere, and merged in tiles, give the nodes of the whole tree."""
    import pandas as pd

    leaves = [H(str(i)) for i in range(45)]
    frame = pd.DataFrame({"g": "a", "n": 45, "level": 0, "first": range(45), "hash": leaves})
    whole = pd.concat(merkle.mountains([frame], 3))
    assert not whole["open"].any() and set(whole["level"]) == {0, 1, 2, 3, 4}
    for cuts in ([7], [1, 2, 3], [9, 27], [13, 14, 40]):
        parts = [pd.concat(merkle.mountains([frame[a:b]], 3)) for a, b in zip([0, *cuts], [*cuts, 45])]
        both = pd.concat(parts)
        rest = both[both["open"]].drop(columns="open").sort_values("first")
        merged = pd.concat([both[~both["open"]], *merkle.mountains([rest], 3)])
        key = lambda d: sorted(zip(d["level"], d["first"], d["hash"]))
        assert key(merged) == key(whole)


def test_manifest_of_one_row_and_none(spark):
    d = table(spark, [(7, "x", "en", "s", 1)])
    r = merkle.verified(d).first()
    assert r.leaf == r.subroot == r.root == leaf(7, "s", "en", 1, "x") and r.path == "" and r.verified == (crc32(b"7") % 7 != 0)
    assert merkle.verified(d.filter("false")).count() == 0


# 11


def phrases(rows, longest=3, least=10, covered=50, top=2000):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault((lang, k), Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang in n:
        c = {p: a for k in range(2, longest + 1) for p, a in f.get((lang, k), {}).items() if a >= least}
        scored = []
        for p, a in c.items():
            cuts = [(1000000 * a * a // (f[lang, k][p[:k]] * f[lang, len(p) - k][p[k:]]), k, f[lang, k][p[:k]], f[lang, len(p) - k][p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in c.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, k + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows():
    g = random.Random(4)
    vocabulary = ["New", "york", "city", "a", "b", "ß", "É", "x\x0by", "l'eau", "日本"]
    rows = [(i, "".join(g.choice(vocabulary) + g.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for _ in range(g.randrange(1, 80))), g.choice(["en", "fr", None, "und"]), None, 0) for i in range(90)]
    return rows + [(90, None, "en", None, 0), (91, "", "xx", None, 0), (92, " .. ", "xx", None, 0), (93, "new york city " * 400, "en", None, 0)] + [rows[0]] * 12


@pytest.mark.parametrize("longest,buckets,chunk", [(3, 1 << 26, 1 << 19), (4, 1 << 17, 64), (2, 1 << 16, 8)])
def test_collocations(spark, longest, buckets, chunk, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKETS", buckets)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "DISTINCT", 1 << 19 if chunk > 64 else 7)
    rows = phrase_rows()
    got = collocations.collocations(table(spark, rows).repartition(3), longest=longest)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases(rows, longest)


def test_collocations_bounds_and_empty(spark):
    rows = phrase_rows()
    got = collocations.collocations(table(spark, rows), least=30, covered=80, top=3)
    assert sorted(map(tuple, got.collect())) == phrases(rows, least=30, covered=80, top=3)
    assert collocations.collocations(table(spark, rows).filter("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    a, left, right = 4_000_000_000, 5_000_000_000, 6_000_000_000
    d = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    exact = lambda *xs: " * ".join(f"cast({x} as decimal(15, 0))" for x in xs)
    assert d.select(F.expr(f"({exact('a', 'a')} * 1000000) div ({exact('l', 'r')})")).first()[0] == 1000000 * a * a // (left * right)


# 12


def model_rows(n=120):
    rows = [(i, prose(300 + i, 60), "en", None, 0) for i in range(n)]
    return rows + [(n, None, None, None, 0), (n + 1, "", None, None, 0), (n + 2, "neverseen " * 5 + "Neverseen", None, None, 0), (None, "the end", None, None, 0)] + [rows[3]] * 2


def held(i):
    return crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("most", [1 << 16, 40])
def test_base_scores_and_counts(spark, most):
    rows = model_rows()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), " "]
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    want = sorted(((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 6)) for i, t, *_ in rows))
    d = table(spark, rows)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    got = language_model.scores(d.repartition(3), held_out, most=most).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert language_model.scores(d.filter("false"), held_out).count() == 0
    alone = language_model.scores(d.filter("doc_id is null"), F.lit(True)).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score) == (3, 0, 0, 0.0)


def small_model():
    words = language_model.listed([(f"w{i}", 50 - i) for i in range(30)], 20, 1100, 60, short=8, bins=4)
    m = language_model.Model.initial(words.counts, 6)
    g = np.random.default_rng(2)
    return words, m.filled(m.flat() + g.normal(0, 0.5, m.flat().size))


def test_probabilities_of_all_words_sum_to_one():
    words, m = small_model()
    n = len(words.counts)
    assert len(set(words.classes)) == n and words.counts.sum() == words.total
    score = language_model.Scorer(m)
    for pair in ((n, n), (0, 3), (n - 1, 2)):
        x = np.array([pair] * len(words.classes))
        p = 10 ** (score(x, words.classes) + words.share)  # each listed word, and the last class as a whole
        assert abs(p.sum() - 1) < 1e-5
        assert np.allclose(score(x, words.classes), language_model.Scorer(m)(x, words.classes))


def test_gradient_against_differences():
    words, m = small_model()
    g = np.random.default_rng(3)
    n = len(words.counts)
    x, y, noise = g.integers(0, n + 1, (5, 2)), g.integers(0, n, 5), g.integers(0, n, 7)
    log_noise = np.log((words.counts + 1) / (words.counts.sum() + n)).astype(np.float32)

    def likelihood(m):
        q = m.before[x[:, 0]].astype(float) @ m.place[0] + m.before[x[:, 1]] @ m.place[1]
        s = lambda c: q @ m.after[c].T.astype(float) + m.bias[c] - log_noise[c] - np.log(len(noise))
        sig = lambda z: 1 / (1 + np.exp(-z))
        return (np.log(sig(np.diag(s(y)))) + np.log(1 - sig(s(noise))).sum(axis=1)).mean()

    grad = np.concatenate([p.ravel() for p in language_model.gradient(m, x, y, noise, log_noise)])
    flat = m.flat()
    for k in g.choice(flat.size, 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert abs((likelihood(m.filled(up)) - likelihood(m.filled(down))) / 2e-2 - grad[k]) < 2e-3


def test_every_training_token_is_an_example_once(spark):
    rows = [(i, prose(i, 50), "en", None, 0) for i in range(60)] + [(60, None, None, None, 0), (61, "", None, None, 0)]
    words = language_model.listed([("the", 9)], 62, 3062, 100)
    m = language_model.train(table(spark, rows).repartition(3), words)
    assert m.examples == sum(len((t or "").split()) + 1 for _, t, *_ in rows)


def test_the_model_learns_what_follows(spark):
    """Texts in which a word says what comes next: held-out texts are likelier than by counts alone."""
    g = random.Random(6)
    after = {f"w{i}": [f"w{(i * 7 + k) % 40}" for k in range(2)] for i in range(40)}

    def text():
        out = [f"w{g.randrange(40)}"]
        while len(out) < 300:
            out.append(g.choice(after[out[-1]]))
        return " ".join(out)

    d = table(spark, [(i, text(), "en", None, 0) for i in range(500)])
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    r = language_model.scores(d, held_out).filter("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert r[0] > r[1] + 0.5
