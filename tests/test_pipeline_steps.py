"""Linear pipelines and registries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textorium.operators.pipeline import Pipeline, Registry


def test_steps_stop_rows_once_and_report(spark):
    seen = spark.sparkContext.accumulator(0)

    def half(x):
        seen.add(1)
        return 10 // x

    d = spark.createDataFrame([(i, i - 2) for i in range(6)] + [(None, 1)], "i int, v int")
    start = Pipeline().keep("low", F.col("i") >= 1)
    p = start.process("half", "v", half, "int").keep("big", F.col("half") > 2).then("twice", lambda x: x.withColumn("twice", F.col("half") * 2))
    assert sorted(map(tuple, p.run(d).collect())) == [(3, 1, 10, 20), (4, 2, 5, 10), (5, 3, 3, 6)]
    assert {r.step: (r.stopped, r.failed) for r in p.report(d).collect()} == {"low": (2, 0), "half": (1, 1), "big": (1, 0)}
    why = {r.i: r._stopped_by for r in p.marked(d).collect()}
    assert why[2].startswith("ZeroDivisionError") and why[1] == "filtered" and why[5] is None
    assert Pipeline().run(d).count() == 7 and len(start.steps) == 1
    with pytest.raises(ValueError):
        start.keep("low", F.lit(True))


def test_first_words_keep_their_length(spark, tmp_path):
    from textorium.plans.registry import QUERIES

    rows = [(1, "de", "Enß los"), (2, "de", "\u00a0Ab"), (3, "en", " \n"), (4, "en", "word\x1cs"), (5, "fr", "x"), (6, "de", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["m10_pipeline_report"](spark, str(tmp_path)).collect()}
    assert got == {("long", 2, 0), ("first", 2, 2), ("language", 1, 0)}


def test_registry():
    r = Registry("chunker")
    r.register("a", lambda n=1: n)

    @r.register("b")
    def make(*, size):
        return size

    assert r.make("a") == 1 and r.make("a", n=3) == 3 and r.make("b", size=2) == 2
    with pytest.raises(KeyError, match="known: a, b"):
        r.make("c")
    with pytest.raises(ValueError, match="already"):
        r.register("a", max)
