"""A paged service whose pages fail now and then: no row twice, none lost."""

from __future__ import annotations

import os
from datetime import date, timedelta

import pytest

from textorium.sources import paged

SCHEMA = "query string, url string, day string, title string"


def service(folder, per_day=5, page=7, fails=2):
    """Stories of each day in pages; every page fails twice before it answers."""

    def fetch(query, first, last, token):
        mark = f"{folder}/{query}-{first}-{token}"
        n = len([f for f in os.listdir(folder) if f.startswith(os.path.basename(mark) + "#")])
        if n < fails:
            open(f"{mark}#{n}", "w").close()
            raise ConnectionError("try again")
        a, b = date.fromisoformat(first), date.fromisoformat(last)
        days = [(a + timedelta(days=i)).isoformat() for i in range((b - a).days + 1)]
        rows = [{"url": f"https://n.org/{d}/{k}", "day": d} for d in days for k in range(per_day) if query != "odd" or k % 2]
        at = int(token or 0)
        return rows[at : at + page], str(at + page) if at + page < len(rows) else None

    return fetch


def test_search_over_failing_pages(spark, tmp_path):
    paged.register(spark, "stories", service(str(tmp_path)), SCHEMA)
    d = paged.search(spark, "stories", ["all", "odd"], "2024-01-01", "2024-01-17", days=5, pause="0")
    rows = [(r.query, r.url) for r in d.collect()]
    days = [(date(2024, 1, 1) + timedelta(days=i)).isoformat() for i in range(17)]
    want = [(q, f"https://n.org/{x}/{k}") for q in ("all", "odd") for x in days for k in range(5) if q == "all" or k % 2]
    assert sorted(rows) == sorted(want) and d.rdd.getNumPartitions() == 8
    items = {r.url: r.queries for r in paged.discovered(d).collect()}
    assert len(items) == 85 and items["https://n.org/2024-01-03/1"] == ["all", "odd"] and items["https://n.org/2024-01-03/2"] == ["all"]
    assert d.select("title").distinct().collect()[0].title is None


def test_nothing_asked_and_pages_that_never_answer(spark, tmp_path):
    paged.register(spark, "stories2", service(str(tmp_path), fails=99), SCHEMA)
    assert paged.search(spark, "stories2", ["all"], "2024-01-02", "2024-01-01").count() == 0
    with pytest.raises(Exception, match="try again"):
        paged.search(spark, "stories2", ["all"], "2024-01-01", "2024-01-01", retries="1", pause="0").collect()


def test_a_page_that_comes_again_is_an_error():
    w = paged.Window("q", "2024-01-01", "2024-01-01")
    with pytest.raises(RuntimeError, match="came again"):
        list(paged.pages(lambda q, a, b, t: ([], "same"), w, 0, 0))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    marks, clock = tmp_path / "marks", tmp_path / "today"
    marks.mkdir()
    paged.register(spark, "stories3", service(str(marks)), SCHEMA, today=lambda: clock.read_text())

    def run():
        s = paged.follow(spark, "stories3", ["all"], "2024-01-01", days=3, pause="0")
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(once=True).start()
        q.awaitTermination(90)
        return sorted(r.url for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect())

    want = lambda n: sorted(f"https://n.org/2024-01-{i:02d}/{k}" for i in range(1, n + 1) for k in range(5))
    clock.write_text("2024-01-04")
    assert run() == want(4)
    clock.write_text("2024-01-09")
    assert run() == want(9)


def test_listing_pages_name_the_next(spark):
    site = {
        "https://s.org/p1": '<a href="https://s.org/pub/a">a</a><a href="https://s.org/about">x</a><a rel="next" href="https://s.org/p2">more</a>',
        "https://s.org/p2": '<a href="https://s.org/pub/b">b</a><a href="https://s.org/pub/b">b</a><a href="https://s.org/p3" rel="next">more</a>',
        "https://s.org/p3": '<a href="https://s.org/pub/c">c</a>',
    }
    paged.register(spark, "listing", paged.link_pages(site.__getitem__, r"/pub/"), "query string, url string")
    rows = paged.search(spark, "listing", ["https://s.org/p1"], "2024-01-01", "2024-01-01").collect()
    assert sorted(r.url for r in rows) == [f"https://s.org/pub/{x}" for x in "abc"]
