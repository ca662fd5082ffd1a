"""Main contents of pages with known bodies."""

from __future__ import annotations

import json
import time

from textorium.operators import pages
from textorium.plans.registry import QUERIES

P = [f"Paragraph {k} says a good deal about the matter at hand, with a clause, and another one, until it ends." for k in range(8)]
BODY = "\n\n".join(P)
AROUND = "<nav><p>Home, about, and more links than anyone needs</p></nav>{}<footer><p>All rights, and wrongs, reserved</p></footer>"


def page(inner, head=""):
    return f"<html><head>{head}</head><body>{AROUND.format(inner)}</body></html>"


def ld(x):
    return f'<script type="application/ld+json">{json.dumps(x)}</script>'


ARTICLE = {"@type": "NewsArticle", "articleBody": BODY.replace('"', "&quot;"), "datePublished": "2024-02-03T10:00:00Z"}
CASES = {
    "selector": (page('<div class="teaser"><p>Short</p></div><div class="x article-body">' + "".join(f"<p>{p}" for p in P) + "</div>"), BODY),
    "list": (page("<p>x</p>", ld([{"@type": "Person"}, ARTICLE])), BODY),
    "graph": (page("<p>x</p>", ld({"@graph": [{"@type": "WebSite"}, {"@graph": [ARTICLE | {"@type": ["Thing", "NewsArticle"]}]}]})), BODY),
    "broken": (page("<article>" + "".join(f"<p>{p}</p>" for p in P) + "</article>", '<script type="application/ld+json">{"@type": "NewsArticle",</script>'), BODY),
    "longest": (page("<article><p>Teaser</p></article><article>" + "".join(f"<p>{p}</p>" for p in P) + '<div class="ads"><p>Buy, buy, buy</p></div></article>'), BODY),
    "density": (page("<div><p>Too short to be it</p></div><div>" + "".join(f"<p>{p}</p>" for p in P[:3]) + "</div>"), "\n\n".join(P[:3])),
    "stripped": ("<b>" + " ".join(P[:3]) + "</b><script>var x = 1</script>", " ".join(P[:3])),
    "none": ("<p>Nothing much</p>", ""),
    "null": (None, ""),
    "empty": ("", ""),
}


def test_known_bodies(spark):
    d = spark.createDataFrame([(k, h) for k, (h, _) in CASES.items()], "name string, html string")
    got = {r.name: r for r in pages.main_content(d, "name").collect()}
    assert {k: r.text for k, r in got.items()} == {k: t for k, (_, t) in CASES.items()}
    assert [got[k].method for k in ("list", "graph")] == ["structured"] * 2 and got["density"].method == "density"
    assert got["stripped"].method == "stripped" and {got[k].method for k in ("none", "null", "empty")} == {"none"}
    assert got["graph"].published_at == got["list"].published_at == "2024-02-03" and got["broken"].published_at is None
    assert pages.main_content(d.limit(0), "name").isEmpty()


def test_unclosed_tags_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        pages.candidates("<div>" * n + "<p>x" * n + "</i>" * n + "</b>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_query_finds_the_paragraphs_of_every_page(spark):
    out = QUERIES["i08_main_content"](spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert sum(r.method != "none" for r in rows) > 0.9 * len(rows)


def test_few_pages_are_objects_at_once(spark, monkeypatch):
    import pyarrow as pa

    runs, plain = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, kinds: runs.append(f) or plain(self, f, kinds))
    d = spark.createDataFrame([(1, "<p>x</p>")], "k long, html string")
    pages.main_content(d, "k")
    html = [None if k % 7 == 0 else f"<article><p>page {k}</p></article>" for k in range(300)]
    out = list(runs[0](iter([pa.RecordBatch.from_pydict({"k": range(300), "_html": html})])))
    assert max(b.num_rows for b in out) <= 64
    assert [(r["k"], r["_selector"]) for b in out for r in b.to_pylist()] == [(k, "" if k % 7 == 0 else f"page {k}") for k in range(300)]
