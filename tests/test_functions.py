"""Functions and operators on literal rows, with the values that the blueprint derives."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textorium.functions import dates, ids, text, urls, vectors
from textorium.operators import actors, chunking, dedup, filters, frames, incremental, metrics, models, retrieval, rollup, sampling, wordcount
from textorium.sources import connectors, corpus, sinks


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "t, keyword, whole, want",
    [
        ("ACME is an organization. The acmeation of documents. We acmed a report. ACME's mission.", "ACME", True, 2),
        ("created creation creative recreate", "crea", True, 0),
        ("created creation creative recreate", "crea", False, 4),
        ("CREA2023 CREA_2023 CREA-2023", "CREA", True, 1),
        ("ACME, coal, transport. ACME's coal-transport system. transportation of coal.", "coal", True, 3),
        ("the trans-\nport and trans-port sector, transport", "transport", True, 3),
        ("", "coal", True, 0),
        (None, "coal", True, 0),
    ],
)
def test_keyword_counts(spark, t, keyword, whole, want):
    assert one(spark, t, text.keyword_count("x", keyword, whole_word=whole)) == want


def test_text_rules(spark):
    assert one(spark, "a. b.. . c", text.statistics("x")["sentence_count"]) == 3
    assert one(spark, "", text.statistics("x")["avg_word_length"]) == 0
    assert one(spark, " Hello END rest", text.clean("x", ["end"])) == "Hello"
    assert one(spark, "ad ad ad", text.clean("x", min_hits={"ad": 3})) is None
    assert one(spark, "spam\nBUY now", text.clean("x", exclude=["^buy", "(bad"])) is None
    assert one(spark, "Wörter an Öl", text.keyword_match("x", "word:an")) and not one(spark, "Öan", text.keyword_match("x", "word:an"))
    assert one(spark, "a(b", text.keyword_match("x", "regex:(b")) is True
    assert one(spark, "However, it", text.starts_with_connector("x")) and not one(spark, "It however", text.starts_with_connector("x"))
    assert one(spark, "the Centre  for\nClean – Air", text.organisation("x", "QZ", ["Centre", "for", "Clean", "Air"]))
    assert one(spark, "one two three", text.shortened("x", 9)) == "one two..."
    assert one(spark, "x on 2024-02-30 and", text.iso_date_in("x")) is None
    assert not one(spark, "Please wait " * 30, text.valid_content("x")) and one(spark, "good words here " * 30, text.valid_content("x"))


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://kota.tribunnews.com/a", "tribunnews.com"), ("http://www.example.co.uk/x", "example.co.uk"), ("https://a.b.example.com:80/", "example.com:80"),
        ("", None), (None, None), ("example.org", "example.org"),
    ],
)
def test_base_domain(spark, url, want):
    assert one(spark, url, urls.base_domain("x")) == want


def test_urls(spark):
    u = "HTTPS://User@WWW.Example.com:8080?b=2&utm_source=x&a=1#top"
    assert one(spark, u, urls.canonical("x")) == "https://www.example.com/?a=1&b=2"
    assert one(spark, "http://news.bbc.co.uk/1", urls.media_source("x")) == "BBC"
    assert one(spark, "http://a.thedailystar.net/1", urls.media_source("x")) == "Daily Star"
    assert one(spark, "nothing", urls.media_source("x")) == "" and one(spark, None, urls.host_or_unknown("x")) == "unknown"
    assert one(spark, "https://x.org/report/1", urls.is_publication("x", "https://x.org"))


def test_dates(spark):
    for s in ("2024-03-05", "2024-03-05T10:00:00Z", "2024-03-05 10:00:00+01:00", "05/03/2024", "March 5, 2024", "20240305"):
        assert one(spark, s, dates.normalised("x")) == dt.date(2024, 3, 5), s
    assert one(spark, "soon", dates.normalised("x")) is None
    assert one(spark, dt.date(2024, 3, 6), dates.period(F.col("x"), "week"), "date") == "2024-03-04"
    assert dates.windows(yearly=("11-01", "02-01"), years=[2020]) == [("2020-11-01", "2021-02-01")]
    assert one(spark, None, dates.in_windows("x", [("2020-01-01", "2021-01-01")])) is False and one(spark, None, dates.in_windows("x", None)) is True
    assert dates.placeholder("today", dt.date(2020, 1, 2)) == "2020-01-02"


def test_ids(spark):
    assert one(spark, "a@@b@@c", ids.split_global(F.col("x"))[1]) == "b@@c" and one(spark, "b", ids.split_global(F.col("x"))[0]) is None
    assert one(spark, "d_chunk_12", ids.parse_chunk_id(F.col("x"))[1]) == 12
    for bad in ("d_chunk_x", "d", "a_chunk_1_chunk_2"):
        assert one(spark, bad, ids.parse_chunk_id(F.col("x"))[1]) is None
    assert len(one(spark, "http://a", ids.document_id(F.col("x")))) == 6


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.96), None]
    assert sum(d.select(vectors.softmax(F.col("a"))).first()[0]) == pytest.approx(1)
    m = spark.createDataFrame([({"a": 0.9, "b": 1.7, "z": 1.0},), ({},)], "m map<string,double>")
    got = [r[0] for r in m.select(vectors.filled(F.col("m"), ["a", "b", "c"])).collect()]
    assert got[0] == {"a": pytest.approx(0.9 / 1.9), "b": pytest.approx(1 / 1.9), "c": 0} and got[1] == {"a": 0, "b": 0, "c": 0}


def test_sentences(spark):
    s = lambda t: one(spark, t, chunking.sentences("x"))
    assert s("The PM2.5 concentration was 34.5 μg/m³. This is high.") == ["The PM2.5 concentration was 34.5 μg/m³.", "This is high."]
    assert s("It caused death.The end") == ["It caused death.", "The end"]
    assert s("") == [] and s(None) == []
    assert len(s("x" * 600)[0]) == 500


def test_packing(spark):
    p = lambda t, n=80: one(spark, t, chunking.packed("x", n))
    say = lambda n, k: " ".join([f"Word{k}"] + ["w"] * (n - 1)) + "."
    assert p(f"{say(30, 1)} {say(30, 2)} {say(30, 3)}") == [f"{say(30, 1)} {say(30, 2)}", say(30, 3)]
    assert p(f"{say(40, 1)}\n\n{say(20, 2)}") == [say(40, 1), say(20, 2)]
    assert p(f"{say(39, 1)}\n\n{say(20, 2)}") == [f"{say(39, 1)} {say(20, 2)}"]
    assert p(f"{say(70, 1)} However {' '.join(['w'] * 17)}.") == [f"{say(70, 1)} However {' '.join(['w'] * 17)}."]
    assert p(f"{say(70, 1)} However {' '.join(['w'] * 18)}.") != [f"{say(70, 1)} However {' '.join(['w'] * 18)}."]
    long = p(say(100, 1))
    assert len(long) == 1 and len(long[0].split()) == 80 and long[0].endswith("...")
    assert p(' He said "yes". ') == [' He said "yes". ']
    assert p("") == []


TEMPORAL = [("doc1", {"a": 0.8, "b": 0.2}, 100.0, "2023-01-15"), ("doc2", {"a": 0.3, "b": 0.7}, 150.0, "2023-01-15"), ("doc3", {"a": 0.5, "b": 0.5}, 200.0, "2023-02-01"), ("doc4", {"a": 0.0, "b": 0.0}, 50.0, "2023-02-01")]


def temporal(spark):
    d = spark.createDataFrame(TEMPORAL, "doc_id string, m map<string,double>, total_weight double, published_at string")
    d = d.withColumn("any_value", F.exists(F.map_values("m"), lambda v: v > 0))
    return d.select("doc_id", "total_weight", "any_value", dates.period(F.to_date("published_at"), "all").alias("period_id"), F.explode("m").alias("frame", "value"))


@pytest.mark.parametrize("keep, weighted, want, n", [(False, True, 0.5, 3), (True, True, 0.45, 4), (False, False, 1.6 / 3, 3)])
def test_rollup(spark, keep, weighted, want, n):
    r = rollup.aggregate(temporal(spark), ["period_id"], keep_empty=keep, weighted=weighted).filter("frame = 'a'").first()
    assert r["value"] == pytest.approx(want) and r["document_count"] == n


def test_frames(spark):
    rows = [("d", 0, "a", 0.9, 10), ("d", 1, "b", 0.1, 10), ("d", 0, "a", 0.1, 30), ("d", 1, "b", 0.9, 30), ("e", 0, "a", 0.0, 5), ("e", 1, "b", 0.0, 5)]
    s = spark.createDataFrame(rows, "doc_id string, frame_idx int, frame string, p double, w int")
    got = {(r.doc_id, r.frame): r for r in frames.weighted_documents(s, ["doc_id"], 0.5, normalize=False).collect()}
    assert got["d", "a"].value == pytest.approx(9 / 40) and got["d", "b"].value == pytest.approx(27 / 40) and not got["e", "a"].any_value
    o = {(r.doc_id, r.frame): r.value for r in frames.occurring_documents(s, ["doc_id"]).collect()}
    assert o == {("d", "a"): 1.0, ("d", "b"): 1.0, ("e", "a"): 0.0, ("e", "b"): 0.0}
    assert {r.doc_id: r.frame_scores["b"] for r in frames.as_maps(frames.weighted_documents(s, ["doc_id"]), ["doc_id"]).collect()}["d"] == pytest.approx(0.7)


def test_equal_shares_tie(spark):
    """Whatever their sums were added up in."""
    rows = [("d", 0, "a", 0.3), ("d", 1, "b", 0.1 + 0.2), ("e", 0, "a", 0.3), ("e", 1, "b", 0.3 + 1e-9)]
    top = frames.top_frames(spark.createDataFrame(rows, "doc_id string, frame_idx int, frame string, value double"), ["doc_id"])
    assert {(r.doc_id, r["rank"]): r.frame for r in top.collect()} == {("d", 1): "a", ("d", 2): "b", ("e", 1): "b", ("e", 2): "a"}


def test_rolling(spark):
    s = spark.createDataFrame([("a", dt.date(2024, 1, 1), 3.0), ("a", dt.date(2024, 1, 4), 6.0), ("b", dt.date(2024, 1, 2), 1.0)], "k string, day date, v double")
    d = rollup.rolling_mean(rollup.dense_days(s, ["k"], "day", "v"), ["k"], "day", "v", 2)
    assert [r.rolling for r in d.filter("k = 'a'").orderBy("day").collect()] == [3.0, 1.5, 0.0, 3.0]
    assert rollup.dense_days(s, ["k"], "day", "v", own_bounds=True).filter("k = 'b'").count() == 1


def test_actors(spark):
    t = '"Coal is vital for growth," said Energy Minister Arifin Tasrif. According to Greenpeace Indonesia, coal plants harm public health. Arifin Tasrif said that transition to renewables is necessary.'
    s = actors.spans(spark.createDataFrame([("d", t), ("e", None)], "doc_id string, text string"))
    rows = s.collect()
    assert sum(r.kind in ("QUOTE", "REPORTED") for r in rows) == 3
    assert all(t[r.start : r.end].strip(",;: ") == r.span for r in rows)
    assert [r.kind for r in rows if r.span == "Greenpeace Indonesia"] == ["ORG"]
    a = actors.attribution(s.filter("kind in ('QUOTE', 'REPORTED')"), s.filter("kind in ('PERSON', 'ORG')")).collect()
    assert sum(r.speaker is not None for r in a) >= 2
    t += ' Mr Hat Man added: "we all went home". Then "nobody was there at all" ended it.'
    d = spark.createDataFrame([("d", t), ("e", None)], "doc_id string, text string")
    s = actors.spans(d)
    a = {r.span: r for r in actors.attribution(s.filter("kind in ('QUOTE', 'REPORTED')"), s.filter("kind in ('PERSON', 'ORG')"), docs=d).collect()}
    assert (a["Coal is vital for growth"].speaker, a["Coal is vital for growth"].attribution_confidence) == ("Energy Minister Arifin Tasrif", 0.85)
    assert (a["we all went home"].speaker, a["we all went home"].attribution_confidence) == ("Mr Hat Man", 0.85)
    assert (a["nobody was there at all"].speaker, a["nobody was there at all"].attribution_confidence) == ("Mr Hat Man", 0.55)


def test_within_sentence(spark):
    c = spark.createDataFrame([("d", 1, 50, 60), ("d", 2, 90, 95)], "doc string, s int, start int, end int")
    m = spark.createDataFrame([("d", 1, 40, "near"), ("d", 1, 10, "far"), ("d", 1, 70, "after"), ("d", 2, 99, "only")], "doc string, s int, start int, span string")
    assert {r.s: r.speaker for r in actors.within_sentence(c, m, "doc", "s").collect()} == {1: "near", 2: "only"}


def test_metrics(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "gold string, predicted string")
    c = {r.label: (r.tp, r.fp, r.fn) for r in metrics.per_class(p).collect()}
    assert c == {"a": (1, 0, 1), "b": (1, 2, 0), "c": (0, 0, 1)}
    assert metrics.averages(metrics.per_class(p)).first().micro == 0.5
    assert metrics.confusion(p).count() == 9
    r = spark.createDataFrame([("f", True, 0.9), ("f", False, 0.9), ("f", False, 0.1), ("g", True, 0.5)], "k string, y boolean, s double")
    got = {x.k: x for x in metrics.ranking(r, "k", "y", "s").collect()}
    assert got["f"].auc == pytest.approx(0.75) and got["g"].auc == got["g"].precision == 0
    assert one(spark, {"x": 0.2, "b": 0.5, "a": 0.5}, metrics.argmax_label(F.col("x")), "map<string,double>") == "a"


def test_word_count(spark):
    d = spark.createDataFrame([(1, "coal coal mine"), (2, "wind"), (3, "coal wind wind"), (4, None)], "doc_id int, text string")
    h = wordcount.theme_hits(d, {"dirty": ["coal", "mine"], "clean": ["wind"], "later": ["mine"]}, "doc_id")
    assert sorted((r.doc_id, r.theme, r.hits) for r in h.collect()) == [(1, "dirty", 2), (1, "later", 1), (2, "clean", 1), (3, "clean", 2), (3, "dirty", 1)]
    assert {(r.a, r.b): r.n_docs for r in wordcount.cooccurrence(h, "doc_id").collect()}["clean", "dirty"] == 1


def test_retrieval(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(7)] + [(9, [0.0, 0.0])], "vec_id int, embedding array<double>")
    got = retrieval.top_k(v.filter("vec_id = 1").withColumnRenamed("vec_id", "query_id"), v, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 4, 2]
    assert retrieval.top_k(v.filter("false").withColumnRenamed("vec_id", "query_id"), v, 3).count() == 0
    with pytest.raises(ValueError):
        retrieval.ensemble([(0.5, F.lit(1))])


def test_sampling(spark):
    c = spark.createDataFrame([("a", 10), ("b", 5), ("c", 0)], "g string, n int")
    for policy in ("equal", "proportional"):
        q = {r.g: r.quota for r in sampling.allocate(c, "g", 8, 1, policy).collect()}
        assert sum(q.values()) == 8 and q["c"] == 0
    d = spark.range(200).withColumn("g", F.when(F.col("id") < 150, "a").otherwise("b"))
    got = sampling.stratified(d, "g", spark.createDataFrame([("a", 7), ("b", 3)], "g string, quota int"), 5, ["id"])
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"a": 7, "b": 3}
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in sampling.stratified(d.repartition(7), "g", spark.createDataFrame([("a", 7), ("b", 3)], "g string, quota int"), 5, ["id"]).collect())


def test_incremental(spark):
    now = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, f string")
    state = spark.createDataFrame([(1, "x"), (2, "old")], "k int, f string")
    assert sorted(r.k for r in incremental.needs_rebuild(now, state, "k", ["f"]).collect()) == [2, 3]
    assert incremental.frontier(now, state.filter("k = 1"), state.filter("k = 2"), "k").count() == 1
    assert sorted(tuple(r) for r in incremental.upsert(state, now.filter("k > 1"), "k").collect()) == [(1, "x"), (2, "y"), (3, "z")]
    assert dedup.last_by(spark.createDataFrame([(1, 1), (1, 2)], "k int, n int"), ["k"], "n").first().n == 2


def test_filters(spark):
    assert one(spark, None, filters.metadata("x", "a", "ne")) is False
    with pytest.raises(ValueError):
        filters.metadata("x", 1, "like")
    assert one(spark, None, filters.lenient_confidence("x", 0.5), "double") and not one(spark, None, filters.strict_confidence("x", 0.5), "double")
    assert one(spark, 0.0, filters.lenient_confidence("x", 0.5), "double") and not one(spark, 0.0, filters.strict_confidence("x", 0.5), "double")


def test_models(spark):
    answer = '```json\n[{"passage_id": "p0", "probs": {"a": 0.6, "zz": 1, "b": "bad"}, "top_frames": ["a", "q"], "rationale": null, "evidence_spans": ["   ", "e1", "e2", "e3", "e4"]}, {"probs": {}}]\n```'
    got = one(spark, answer, models.parsed_annotations(F.col("x"), ["a", "b"]))
    assert len(got) == 1 and got[0].probabilities == {"a": 0.6} and got[0].top_frames == ["a"] and got[0].rationale == "" and got[0].evidence == ["e1", "e2", "e3"]
    assert one(spark, "no json", models.parsed_annotations(F.col("x"), ["a"])) == []
    assert one(spark, "1. First one\n2) Second", models.numbered_findings(F.col("x"))) == ["First one", "Second"]
    assert one(spark, '<time datetime="2024-01-02T10:00">', models.published(F.col("x"))) == "2024-01-02"
    t = one(spark, ["Um hello (there)...", "[music] All [sic] sort of good", "we go!!", " Then one.", "Last"], models.transcript(F.col("x")), "array<string>")
    assert t == "hello (there).. All [sic] sort of good we go!.\n\nThen one..\n\nLast"
    d = spark.createDataFrame([("coal is bad", "coal is very bad"), ("coal is bad", "coal is not bad")], "a string, b string")
    s = [r[0] for r in d.select(models.pair_scorer()(F.col("a"), F.col("b"))).collect()]
    assert s[0]["entails"] == 1 and s[1]["contradicts"] == 1
    assert one(spark, "some words", models.embedder()(F.col("x"))) == one(spark, "words some", models.embedder()(F.col("x")))
    assert one(spark, "Hello World", models.located(F.col("x"), F.lit("world"))) == 6


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "index.jsonl").write_text('{"id": "a", "url": "u"}\n\nnot json\n{"id": ""}\n{"id": "a", "url": "v"}\n')
    for k, meta, fetch in (("a", '{"title": "T", "uri": "http://a"}', '{"title": "F"}'), ("b", "broken", "{}")):
        (tmp_path / "documents" / k).mkdir(parents=True)
        (tmp_path / "documents" / k / "text.txt").write_text(f"text {k}\nline")
        (tmp_path / "documents" / k / "meta.json").write_text(meta)
        (tmp_path / "documents" / k / "fetch.json").write_text(fetch)
    assert corpus.read_index(spark, f"{tmp_path}/index.jsonl").count() == 2
    assert corpus.line_count(spark, f"{tmp_path}/index.jsonl").first().n == 4
    got = {r.doc_id: r for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert got["a"].title == "F" and got["a"].url == "http://a" and got["a"].text == "text a\nline" and got["b"].url == "" and got["b"].meta == {}
    both = corpus.union_corpora({"x": corpus.read_texts(spark, str(tmp_path)), "y": corpus.read_texts(spark, str(tmp_path))})
    assert sorted(r.doc_id for r in both.collect()) == ["x@@a", "x@@b", "y@@a", "y@@b"]
    corpus.write_documents(both, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    corpus.append_index(spark.createDataFrame([("q", "u")], "id string, url string"), f"{tmp_path}/idx")
    assert corpus.read_index(spark, f"{tmp_path}/idx").first().id == "q"


def test_library_folder(spark, tmp_path):
    doc = {"doc_id": "d1", "url": "u", "title": "t", "published_at": None, "findings": [{"finding_id": "d1_000", "text": "x", "confidence": 0.5, "category": "c", "keywords": ["k"]}]}
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "findings.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "d2.json").write_text(json.dumps(doc | {"doc_id": "d2", "findings": []}))
    lib = corpus.read_library(spark, str(tmp_path))
    assert lib.count() == 2 and corpus.findings(lib).first().finding_id == "d1_000"
    corpus.export_library(lib, f"{tmp_path}/export")
    assert sorted(r.findings_count for r in spark.read.json(f"{tmp_path}/export").collect()) == [0, 1]


def test_connectors(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("no")
        return f"body of {url}"

    r = spark.createDataFrame([("u1",), ("bad",)], "url string")
    got = {x.url: x for x in connectors.fetched(r, fetch, retries=1).collect()}
    assert got["u1"].body == "body of u1" and got["bad"].body is None and "OSError" in got["bad"].error and got["bad"].attempts == 2
    cache = spark.createDataFrame([("u1", "kept")], "url string, body string")
    assert {x.url: x.body for x in connectors.with_cache(r, cache, fetch).collect()} == {"u1": "kept", "bad": None}
    assert connectors.compiled({"en": ["coal", "air quality"], "de": ["Kohle"]}) == '(coal OR "air quality") OR (Kohle)'
    rows = spark.createDataFrame([(["41", "Germany", "26/09/2021"],), (["41", "Germany", "2017-09"],), (["11", "Sweden", "2021"],)], "row array<string>")
    e = connectors.election_rows(connectors.records(rows, ["country", "countryname", "edate"]), ["GERMANY"], ["2021"])
    assert e.count() == 1
    assert connectors.links(spark.createDataFrame([('<a href="http://x/report/1#t"> <a href="http://y/">',)], "html string"), "http://x/").first().url == "http://x/report/1"


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    sinks.csv(d, f"{tmp_path}/c", ["k"])
    assert [r.v for r in spark.read.csv(f"{tmp_path}/c", header=True).collect()] == ["a", "b"]
    sinks.json_lines(d, f"{tmp_path}/j")
    sinks.named({"x": d, "y": d}, f"{tmp_path}/n")
    sinks.chunk_store(d, f"{tmp_path}/s", "one")
    sinks.chunk_store(d.limit(1), f"{tmp_path}/s", "two")
    assert spark.read.json(f"{tmp_path}/j").count() == 2 and spark.read.parquet(f"{tmp_path}/n/y").count() == 2 and spark.read.parquet(f"{tmp_path}/s").count() == 3
    assert "<table" in sinks.html_table(d, "T")


def test_streams(spark, tmp_path):
    from textorium.streaming import events

    e = spark.createDataFrame([(k, dt.datetime(2024, 1, 1 + k // 10, k % 10), k % 3, "view" if k % 2 else "click", 1.0, "{}") for k in range(60)], events.EVENTS)
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = events.windowed_counts(events.read_stream(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == 60
    q = events.first_seen(events.read_stream(spark, f"{tmp_path}/in"), "user_id").writeStream.outputMode("append").format("memory").queryName("f").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from f").first()[0] == 3


def test_actor_counts_of_all_documents(spark):
    """Every document counts, whatever its language and characters, against plain regular expressions."""
    import os
    import re
    from collections import Counter

    from textorium.operators import actors
    from textorium.plans import registry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect():
        want.update(m[1] for m in re.finditer(actors.CAPITALISED, r.text or ""))
    got = {r.actor: r.n for r in registry.QUERIES["d14_actor_counts"](spark, folder).collect()}
    assert got == dict(want) and len(got) > 10


def test_top_k_in_blocks(spark, monkeypatch):
    """Several blocks of queries give what one gives."""
    g = np.random.default_rng(2)
    v = spark.createDataFrame([(k, [float(x) for x in g.normal(size=4)]) for k in range(60)] + [(99, [0.0] * 4)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    order = lambda d: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in d.collect())
    want = order(retrieval.top_k(q, v, 7))
    assert len(want) == 12 * 7
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    assert order(retrieval.top_k(q, v, 7)) == want


def test_top_k_scores_few_rows_at_once(spark, monkeypatch):
    """A task's memory doesn't grow with queries times vectors; ties and vectors without length across the seams."""
    import tracemalloc

    import pandas as pd

    g = np.random.default_rng(4)
    x = g.integers(-2, 3, (4000, 3)).astype(float)
    q = spark.createDataFrame(pd.DataFrame({"query_id": range(2000), "embedding": x[:2000].tolist()}))
    v = spark.createDataFrame(pd.DataFrame({"vec_id": range(10), "embedding": x[:10].tolist()}))
    runs, plain = [], type(v).mapInPandas
    monkeypatch.setattr(type(v), "mapInPandas", lambda self, f, kinds: runs.append(f) or plain(self, f, kinds))
    retrieval.top_k(q, v, 7)
    batch = pd.DataFrame({"i": range(4000), "v": list(x)})
    tracemalloc.start()
    got = pd.concat(list(runs[0](iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    some = {k: list(d["i"]) for k, d in got.groupby("q")}
    n = np.linalg.norm(x, axis=1)
    assert set(some) == {j for j in range(2000) if n[j]}
    for j in sorted(some)[::97]:
        cos = np.divide(x @ x[j], n * n[j], out=np.full(4000, -9.0), where=n > 0).round(9)
        assert cos[some[j]].tolist() == sorted(cos, reverse=True)[:7]


def test_clean_binds_its_steps_once(spark):
    d = spark.createDataFrame([(1, "  keep this LICENSE all gone "), (2, "spam spam"), (3, None), (4, "a!!b")], "id int, t string")
    got = {r.id: r.c for r in d.select("id", text.clean("t", ["License", "this"], ["!!", "("], {"spam": 2}).alias("c")).collect()}
    assert got == {1: "keep", 2: None, 3: None, 4: None}


@pytest.mark.parametrize("n, k", [(0, 3), (2, 5), (17, 5), (100, 7)])
def test_folds_have_exact_sizes(spark, n, k):
    got = [r["count"] for r in sampling.folds(spark.range(n), k, 3, "id").groupBy("fold").count().orderBy("fold").collect()]
    assert got == [x for x in (n // k + (i < n % k) for i in range(k)) if x]
