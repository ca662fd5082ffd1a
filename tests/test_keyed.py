"""Keyed upserts, extractors in order, conditional fetches over a store of bodies."""

from __future__ import annotations

import glob
import hashlib
import os

from pyspark.sql import functions as F

from textorium.sources.blobs import BlobStore
from textorium.sources.keyed import KeyedTable, first_to_find, rates

ROW = "url string, doc_id string, findings array<string>, at int"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", buckets=8)
    assert t.rows() is None and t.counts().first().asDict() == {"documents": 0, "findings": 0}
    rows = [(f"u{i}", f"d{i}", ["a"] * (i % 3), 0) for i in range(60)]
    assert t.upsert(spark.createDataFrame(rows, ROW)) == list(range(8))
    before = files(tmp_path / "t")
    new = [("u5", "d5", ["x", "y"], 1), ("u5", "d5", ["last"], 2), ("u99", "d99", None, 1), (None, "d", None, 1)]
    touched = t.upsert(spark.createDataFrame(new, ROW), "at")
    assert 0 < len(touched) <= 2
    after = files(tmp_path / "t")
    assert all(after[f] == m for f, m in before.items())
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in set(after) - set(before)} == set(touched)
    want = {u: (d, f or []) for u, d, f, _ in rows} | {"u5": ("d5", ["last"]), "u99": ("d99", [])}
    assert {r.url: (r.doc_id, r.findings or []) for r in t.rows().collect()} == want
    assert t.counts().first().asDict() == {"documents": 61, "findings": sum(len(f) for _, f in want.values())}
    some = spark.createDataFrame([("u5",), ("u7",), ("gone",)], "url string")
    assert sorted(r.url for r in t.rows(some).collect()) == ["u5", "u7"]
    assert sorted((r.url, r.doc_id, r.n) for r in t.index(some).collect()) == [("u5", "d5", 1), ("u7", "d7", 1)]
    assert t.upsert(spark.createDataFrame([], ROW)) == []


def test_extractors_in_order_until_one_finds(spark):
    seen = []

    def extractor(name, finds):
        def run(d):
            seen.append((name, sorted(r.url for r in d.collect())))
            return d.select("url", F.when(F.col("url").isin(*finds), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")).alias("findings"), F.when(F.col("url") == "u4", F.lit(f"{name} failed")).alias("error"))

        return name, run

    d = spark.createDataFrame([(f"u{i}", i) for i in range(5)], "url string, k int")
    out = first_to_find(d, "url", [extractor("one", ["u0", "u1"]), extractor("two", ["u1", "u2"])])
    got = {r.url: (r.findings, r.extractor, r.error) for r in out.collect()}
    assert got == {"u0": (["one"], "one", None), "u1": (["one"], "one", None), "u2": (["two"], "two", None), "u3": ([], None, None), "u4": ([], None, "two failed")}
    assert seen == [("one", [f"u{i}" for i in range(5)]), ("two", ["u2", "u3", "u4"])]
    assert {r.extractor: (r.documents, r.share) for r in rates(out).collect()} == {"one": (2, 0.4), "two": (1, 0.2), None: (2, 0.4)}


def test_conditional_fetches(spark, tmp_path):
    store, log = BlobStore(spark, f"file://{tmp_path}/b"), str(tmp_path / "log")

    def server(pages):
        def fetch(url, etag, modified):
            with open(log, "a") as f:
                f.write(f"{url} {etag}\n")
            if pages[url] is None:
                raise ConnectionError("down")
            tag = hashlib.md5(pages[url]).hexdigest()
            return (304, None, None, None) if etag == tag else (200, pages[url], tag, "today")

        return fetch

    urls = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "url string")
    out = lambda p, **o: {r.url: (r.outcome, r.error) for r in store.refresh(urls, server(p), **o).collect()}
    assert out({"a": b"same", "b": b"same", "c": None}, retries=1) == {"a": ("new", None), "b": ("new", None), "c": ("failed", "ConnectionError: down")}
    assert store.blobs().count() == 1  # equal bodies once
    assert open(log).read().split("\n").count("c None") == 2  # a second try
    assert out({"a": b"same", "b": b"other", "c": b"late"}) == {"a": ("same", None), "b": ("changed", None), "c": ("new", None)}
    assert {r.url: bytes(r.body) for r in store.bodies().collect()} == {"a": b"same", "b": b"other", "c": b"late"}
    assert store.blobs().count() == 3
    out({"a": None, "b": b"other", "c": b"late"}, retries=0)  # a failure keeps what was known
    assert {r.url: bytes(r.body) for r in store.bodies(urls.filter("url = 'a'")).collect()} == {"a": b"same"}
    n = len(open(log).read())
    assert set(out({}, max_age="1 day").values()) == {("fresh", None)} and len(open(log).read()) == n
