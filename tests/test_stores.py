"""Stores on files: second runs, changed texts, damaged files, runs that fail half-way."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from textorium.operators import chunking
from textorium.sources.stores import Store, embedded, fingerprinted, index_rows

TEXTS = {i: f"This is text {i} of the lot. It says a little more. And it ends here." for i in range(40)}


def docs(spark, texts):
    return fingerprinted(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "text")


class Made:
    """Counts the items that are made."""

    def __init__(self):
        self.ids = []

    def chunk(self, d):
        self.ids.append(sorted(r.doc_id for r in d.select("doc_id").collect()))
        return chunking.sentence_chunks(d.repartition(4, "doc_id"), "doc_id")

    def embed(self, d):
        self.ids.append(sorted({r.doc_id for r in d.select("doc_id").collect()}))
        return d.select("doc_id", "chunk_id", F.array(F.length("chunk").cast("float"), F.lit(1.0).cast("float")).alias("vector"))


def test_second_run_makes_nothing_and_a_changed_text_only_itself(spark, tmp_path):
    store, made = Store(spark, f"file://{tmp_path}/chunks"), Made()
    first = store.materialise(docs(spark, TEXTS), "s", made.chunk)
    assert first.count() == 120
    again = store.materialise(docs(spark, TEXTS), "s", made.chunk)
    assert again.count() == 120 and len(made.ids) == 1
    changed = TEXTS | {7: "Now it is one sentence", 99: ""}
    rows = store.materialise(docs(spark, changed), "s", made.chunk)
    assert made.ids[1:] == [[7, 99]]
    assert rows.count() == 118 and [r.chunk for r in rows.filter("doc_id = 7").collect()] == ["Now it is one sentence"]
    store.materialise(docs(spark, changed), "s", made.chunk)  # the empty text has a state
    assert len(made.ids) == 2
    assert store.stats(docs(spark, changed), "s").first().asDict() == {"documents": 41, "available": 41, "rows": 118, "share": 1.0}
    store.compact("s")
    assert len(store.parts("s")) == 1 and store.rows("s").count() == 118


def test_specs_are_apart_and_nothing_new_is_made_unless_allowed(spark, tmp_path):
    store, made = Store(spark, f"file://{tmp_path}/chunks"), Made()
    few = {i: TEXTS[i] for i in range(5)}
    store.materialise(docs(spark, few), "s", made.chunk)
    assert store.materialise(docs(spark, TEXTS), "s", made.chunk, allow_new=False).count() == 15
    assert len(made.ids) == 1
    with pytest.raises(LookupError):
        store.rows("other")
    store.materialise(docs(spark, few), "s", made.chunk, reload=False)
    assert made.ids == [[0, 1, 2, 3, 4]] * 2 and store.rows("s").count() == 15


def test_damaged_and_lost_files_make_their_own_keys_only(spark, tmp_path):
    store, made = Store(spark, f"file://{tmp_path}/chunks"), Made()
    store.materialise(docs(spark, TEXTS), "s", made.chunk)
    files = sorted(glob.glob(f"{tmp_path}/chunks/data/*/*.parquet"), key=os.path.getsize)[-2:]
    hit = sorted(r.doc_id for f in files for r in spark.read.parquet(f"file://{f}").select("doc_id").distinct().collect())
    assert 0 < len(hit) < len(TEXTS)
    with open(files[0], "r+b") as f:
        f.truncate(os.path.getsize(files[0]) // 2)
    os.remove(f"{os.path.dirname(files[0])}/.{os.path.basename(files[0])}.crc")
    os.remove(files[1])
    spark.catalog.clearCache()
    assert sorted(r.doc_id for r in store.damaged("s").collect()) == hit
    rows = store.materialise(docs(spark, TEXTS), "s", made.chunk, verify=True)
    assert made.ids[1:] == [hit]
    assert rows.count() == 120 and store.damaged("s").isEmpty()


def test_a_run_that_fails_leaves_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/chunks")
    fail = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception):
        store.materialise(docs(spark, TEXTS), "s", lambda d: d.select("doc_id", fail("doc_id").alias("chunk")))
    assert store.parts("s") == []
    made = Made()
    assert store.materialise(docs(spark, TEXTS), "s", made.chunk).count() == 120


def test_vectors_follow_their_chunks(spark, tmp_path):
    chunks, vectors, made = Store(spark, f"file://{tmp_path}/c"), Store(spark, f"file://{tmp_path}/v"), Made()
    run = lambda t: embedded(docs(spark, t), chunks, vectors, "c1", "e1", made.chunk, made.embed)
    assert run({i: TEXTS[i] for i in range(3)}).count() == 9
    made.ids.clear()
    v = run({i: TEXTS[i] for i in range(4)} | {1: "Only one"})
    assert made.ids == [[1, 3], [1, 3]]
    assert sorted(r.id for r in index_rows(v).collect()) == sorted([f"{i}_chunk_{k}" for i in (0, 2, 3) for k in range(3)] + ["1_chunk_0"])
