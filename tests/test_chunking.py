"""Packing, windows and attributions, row by row against plain versions over random texts."""

from __future__ import annotations

import random
import re


from textorium.functions.text import CONNECTORS
from textorium.operators import actors, chunking

END = re.compile(chunking.BOUNDARY, re.ASCII)


def split(text):
    return [x for x in (y.strip(" \t\n\x0b\x0c\r") for y in END.sub(r"\1" + "\x01", text).split("\x01")) if x]


def pack(text, most):
    if '"' in text and len(text.split()) <= most:
        return [text]
    out, now, n = [], [], 0
    for paragraph in re.split(r"\n\s*\n", text):
        if not paragraph.strip():
            continue
        if now and n >= most / 2:
            out, now, n = [*out, " ".join(now)], [], 0
        for s in split(paragraph):
            k = len(s.split())
            if k > most:
                cut = " ".join(s.split()[:most])
                out += ([" ".join(now)] if now else []) + [cut if cut[-1] in ".!?" else cut + "..."]
                now, n = [], 0
                continue
            first = re.sub(r"[.,!?:;]+$", "", s.split()[0].lower())
            attached = first in CONNECTORS or any(re.search(p, s, re.I) for p in chunking.ATTRIBUTIONS)
            if not now or n + k <= most or (n + k <= most * 1.1 and attached) or (k < 12 and n < most / 2):
                now, n = [*now, s], n + k
            else:
                out, now, n = [*out, " ".join(now)], [s], k
    return out + ([" ".join(now)] if now else [])


def texts():
    g = random.Random(11)
    words = ["Alpha", "beta", "gamma", "However,", "but", "said", 'said"', '”, according to', "delta", "Epsilon"]
    out = []
    for _ in range(150):
        t = ""
        for _ in range(g.randrange(1, 25)):
            t += " ".join(g.choice(words) for _ in range(g.randrange(1, 30))) + g.choice([".", "!", "?", ".", ""]) + g.choice([" ", " ", "\n", "\n\n", "\n \n"])
        out.append(t)
    return [*out, "", "  \n\n ", "one", 'He "spoke" up.', "word " * 200]


def test_packed_chunks(spark):
    rows = list(enumerate(texts()))
    d = spark.createDataFrame(rows, "i int, t string")
    for most in (12, 40):
        got = {r.i: r.c for r in d.select("i", chunking.packed("t", most).alias("c")).collect()}
        assert got == {i: pack(t, most) for i, t in rows}


def cut(text, limit, overlap):
    text, out, start = text.strip(), [], 0
    while start < len(text):
        end = min(len(text), start + limit)
        spaces = [i for i in range(start + int(limit * 0.4) + 1, end) if text[i] == " "]
        if end < len(text) and spaces:
            end = spaces[-1]
        out.append(text[start:end].strip())
        if end == len(text):
            break
        start = end - overlap if end - overlap > start else end
    return [x for x in out if x]


def test_windows(spark):
    rows = [*enumerate(texts()), (999, None), (1000, "x" * 500), (1001, "a " * 300)]
    d = spark.createDataFrame(rows, "i int, t string")
    for limit, overlap in ((60, 12), (50, 0), (20, 19), (10, 30)):
        got = {}
        for r in chunking.windows(d, "i", "t", limit, overlap).collect():
            i, _, k = r.passage_id.partition("::chunk")
            got.setdefault(int(i), {})[int(k or 1)] = r.passage
        want = {i: {k + 1: x for k, x in enumerate(c)} for i, t in rows if (c := cut(t or "", limit, overlap))}
        assert got == want


def test_speakers_are_the_last_named_before(spark):
    """Each claim with the mention that starts last at or before it, found by looking at all mentions of its document."""
    g = random.Random(2)
    names = ["Anna Berg", "Jon Doe", "Max Ray"]
    rows = [(i, " ".join(g.choice([*names, 'says "It is so."', "claims that it will rest", "and then", "quietly"]) + g.choice(["", ".", ","]) for _ in range(25))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    s = actors.spans(d)
    claims, mentions = s.filter("kind in ('QUOTE', 'REPORTED')"), s.filter("kind in ('PERSON', 'ORG')")
    said = [tuple(r) for r in mentions.collect()]
    got = {(r.doc_id, r.kind, r.start, r.end): r.speaker for r in actors.nearest_before(claims, mentions, "doc_id", "start", "start", "span").collect()}
    assert len(got) > 50
    for (doc, _, start, _), speaker in got.items():
        before = [(m[2], m[4]) for m in said if m[0] == doc and m[2] <= start]
        assert speaker == (max(before)[1] if before else None)
    assert {k[:1] for k in got} <= {(i,) for i, _ in rows}
