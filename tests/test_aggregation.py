"""Strategies over skewed keys, table functions, evaluation, errors that rows carry."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textorium.functions import tables, text
from textorium.operators import actors, aggregation, chunking, evaluation, filters, frames


def scores(spark, n=4000):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(3), rng.random() ** 3, float(rng.randrange(1, 9))) for _ in range(n)]
    return spark.createDataFrame(rows, "corpus string, frame_idx int, p double, w double").withColumn("frame", F.array(*map(F.lit, "xyz"))[F.col("frame_idx")])


def rows(d):
    return sorted(((r.corpus or "", r.frame, round(r.value, 9), round(r.total_weight, 6), r.any_value) for r in d.collect()))


def grid(spark, s):
    """Every key with every frame, as the strategies return them."""
    zero = s.select("corpus").distinct().select("corpus", F.explode(F.array(*map(F.lit, range(3)))).alias("frame_idx")).withColumns({"p": F.lit(0.0), "w": F.lit(0.0)})
    return s.unionByName(zero.withColumn("frame", F.array(*map(F.lit, "xyz"))[F.col("frame_idx")]))


@pytest.mark.parametrize("held", [8, 1 << 16])
def test_strategies_equal_the_fixed_rules_on_a_skewed_key(spark, held, monkeypatch):
    monkeypatch.setattr(aggregation, "HELD", held)
    s = grid(spark, scores(spark)).repartition(8)
    run = lambda rule: aggregation.by_frame(aggregation.aggregate(s.drop("frame"), ["corpus"], rule), ["corpus"], "xyz")
    got, want = rows(run(aggregation.Occurring(3, 0.6))), rows(frames.occurring_documents(s, ["corpus"], 0.6))
    assert got == want and len(got) == 12
    got, want = rows(run(aggregation.Weighted(3, 0.2))), rows(frames.weighted_documents(s, ["corpus"], 0.2))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert aggregation.aggregate(s.drop("frame").limit(0), ["corpus"], aggregation.Weighted(3)).isEmpty()


def test_a_hot_key_leaves_each_task_once(spark):
    class Count(aggregation.Strategy):
        state, result = "n long, rows long", "n long, rows long"

        def accumulate(self, f):
            return f.groupby("key", as_index=False).agg(n=("frame_idx", "size")).assign(rows=1)

        def merge(self, s):
            return s.groupby("key", as_index=False).agg(n=("n", "sum"), rows=("rows", "max"))

        def finalize(self, s):
            return s

    s = scores(spark).repartition(8)
    got = {r.corpus: r.n for r in aggregation.aggregate(s.select("corpus", "frame_idx"), ["corpus"], Count()).collect()}
    assert got == {r.corpus: r["count"] for r in s.groupBy("corpus").count().collect()}


def test_table_functions_in_lateral_joins(spark):
    texts = [(1, 'One. Two "three" said Mr. Smith. Four!\n\nNew part? Yes.'), (2, None), (3, "  ")]
    d = spark.createDataFrame(texts, "doc_id int, text string")
    tables.register(spark, {"words": str.split})
    d.createOrReplaceTempView("lateral_docs")
    got = spark.sql("select d.doc_id, c.chunk_id, c.chunk from lateral_docs d, lateral text_chunks(d.text, 'sentences') c").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chunking.sentence_chunks(d, "doc_id").collect()))
    got = spark.sql("select d.doc_id, c.* from lateral_docs d, lateral text_chunks(d.text) c")
    assert got.columns == ["doc_id", "chunk_id", "chunk", "chunker"] and {r.chunker for r in got.collect()} == {"sentences", "paragraphs", "words"}
    got = spark.sql("select d.doc_id, s.* from lateral_docs d, lateral text_spans(d.text) s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, actors.spans(d).collect()))
    with pytest.raises(Exception, match="the chunker must be one of"):
        spark.sql("select * from lateral_docs d, lateral text_chunks(d.text, 'none') c").schema


def test_scorers_meet_datasets_by_task(spark):
    s = spark.createDataFrame([("s1", ["a", "b", "b"]), ("s2", ["c", None]), ("s3", []), ("s4", None)], "s string, tasks array<string>")
    k = spark.createDataFrame([("k1", ["b", "a"]), ("k2", ["c"]), ("k3", [None])], "k string, tasks array<string>")
    assert sorted(map(tuple, evaluation.matched(s, k, "s", "k").collect())) == [("s1", "k1", 2), ("s2", "k2", 1)]
    gold = spark.createDataFrame([("k", i, "x" if i < 3 else "y") for i in range(5)], "k string, i int, label string")
    said = spark.createDataFrame([("s", "k", i, "x") for i in range(4)], "s string, k string, i int, predicted string")
    r = evaluation.evaluated(said, gold, "s", "k", "i").first()
    assert (r.n, r.accuracy, round(r.macro_f1, 6)) == (5, 0.6, round((6 / 7 + 0) / 2, 6))
    assert [x.i for x in evaluation.samples(said, gold, "s", "k", "i", 5).collect()] == [3]


def test_binarised_scores(spark):
    d = spark.createDataFrame([(1, "a", 2.0), (1, "b", 0.0), (1, "c", 2.0), (2, "a", -1.0)], "i int, l string, s double")
    on = lambda **o: sorted((r.i, r.l, r.on) for r in evaluation.binarised(d, ["i"], "s", **o).collect())
    assert on() == [(1, "a", 1), (1, "b", 1), (1, "c", 1), (2, "a", 0)]
    assert on(top=1) == [(1, "a", 1), (1, "b", 0), (1, "c", 0), (2, "a", 1)]


def test_errors_stay_with_their_rows(spark):
    d = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    got = filters.captured(d, "v", int, "long").collect()
    assert [r.result for r in got] == [1, None, None]
    assert got[1].error.startswith("ValueError: invalid literal") and got[2].error.startswith("TypeError")


def test_dates_by_the_first_pattern_that_finds_one(spark):
    said = {"on 2024-13-45 and 2024-02-03": "2024-02-03", "3  march 2024, 2024/05/06": "2024-05-06", "12/31/2023": "2023-12-31", "31/12/2023": None,
            "3 May 2021": "2021-05-03", "May 3, 2021": "2021-05-03", "june 7 1999": "1999-06-07", "no 12 day 2021": None, None: None}
    d = spark.createDataFrame([(k,) for k in said], "t string")
    assert [r.d for r in d.select(text.date_in("t").alias("d")).collect()] == list(said.values())
