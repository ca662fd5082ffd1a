"""Places of passages against a search over every start, and annotated documents put together again."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from textorium.operators import annotation


def plainly(text, passages):
    """Every start in order, for the first that is free; then the tolerant pattern from every start that is free."""
    used, out = [], []
    for x in passages:
        free = lambda s, e: all(e <= a or s >= b for a, b in used)
        n = len(x)
        at = next(((s, s + n) for s in range(len(text) - n + 1) if text[s : s + n].lower() == x.lower() and free(s, s + n)), None)
        if at is None:
            words = r"\s+".join(re.escape(w).replace(r"\.\.\.", ".{0,160}?") for w in x.split())
            bounds = sorted({0, len(text), *(y for u in used for y in u)})
            for a, b in zip(bounds, bounds[1:]):
                if free(a, b) and (m := re.compile(words, re.I | re.S).search(text, a, b)):
                    at = m.span()
                    break
        if at:
            used.append(at)
            out.append(at)
    return sorted(out)


def test_places_equal_a_search_over_every_start(spark):
    rng = random.Random(5)
    docs, rows = [], []
    for i in range(60):
        words = [rng.choice(["ab", "Ab", "c", "d", "ef", "AB"]) for _ in range(rng.randrange(1, 40))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\n"]) for w in words)
        docs.append((i, text))
        for k in range(rng.randrange(0, 9)):
            a = rng.randrange(len(words))
            x = words[a : a + rng.randrange(1, 5)]
            rows.append((i, k, " ".join(x) if rng.random() < 0.8 else f"{x[0]} ... {x[-1]}", {"one": rng.random(), "two": rng.random()}))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(rows, "doc_id long, k int, passage string, probs map<string,double>").withColumn("top", annotation.top_frame(F.col("probs")))
    got = {}
    for r in annotation.located_spans(d, p, "k").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    want = {i: w for i, t in docs if (w := plainly(t, [x for j, _, x, _ in rows if j == i]))}
    assert {i: sorted(s) for i, s in got.items()} == want


def test_annotated_documents(spark):
    text = "Prices rise & fall. They\n said so... and left. Prices rise & fall."
    d = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "doc_id int, text string")
    rows = [(1, 0, "prices RISE & fall.", {"b": 0.5, "a": 0.5}), (1, 1, "They said ... left.", {"a": 0.9, "b": 0.1}), (1, 2, "Prices rise & fall.", {"b": 0.01}),
            (1, 3, "Prices rise & fall.", {"b": 1.0}), (1, 4, "  ", {"a": 1.0}), (2, 0, "x", {"a": 1.0}), (3, 0, "nothing", {"a": 0.0})]
    p = spark.createDataFrame(rows, "doc_id int, k int, passage string, probs map<string,double>").withColumn("top", annotation.top_frame(F.col("probs")))
    spans = annotation.located_spans(d, p, "k")
    found = sorted((r.start, r.end, r.frame, r.gap) for r in spans.collect())
    assert found == [(0, 19, "a", 0), (20, 46, "a", 1), (47, 66, "b", 1)]
    parts = annotation.segments(d, spans).orderBy("doc_id", "n").collect()
    assert {r.doc_id for r in parts} == {1} and "".join(r.segment for r in parts) == text
    assert [r.frame for r in parts] == ["a", None, "a", None, "b"]
    page = annotation.html(annotation.segments(d, spans), {"a": "#ff0000"}).first().html
    assert page.startswith('<span class="frame" style="background-color: rgba(255, 0, 0, 0.50);" title="a (0.50)">Prices rise &amp; fall.</span> ')
    assert "They<br>\n said" in page and 'rgba(0, 0, 0, 0.20);" title="b (0.01)"' in page
    assert annotation.located_spans(d.limit(0), p, "k").isEmpty()


def test_few_documents_are_objects_at_once(spark, monkeypatch):
    import pyarrow as pa

    runs, plain = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, kinds: runs.append(f) or plain(self, f, kinds))
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, 0, "a", ("f", 0.5))], "doc_id long, o int, passage string, top struct<frame:string,p:double>")
    annotation.located_spans(docs, passages, "o")
    own = [[{"o": 0, "x": "b", "f": "f", "p": 0.5}]] * 300
    out = list(runs[0](iter([pa.RecordBatch.from_pydict({"doc_id": range(300), "_text": ["a" * k + "b" for k in range(300)], "_own": own})])))
    assert max(b.num_rows for b in out) <= 64
    assert [r["_spans"][0]["start"] for b in out for r in b.to_pylist()] == list(range(300))
