"""Result files: round trips, defaults, stale and broken files."""

from __future__ import annotations

import json

import pytest

from textorium.sources import records


def test_assignments(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"passage_id": "p1", "probabilities": {"x": 0.5}, "top_frames": ["x"]}, {"passage_text": "no id"}]))
    d = records.read_assignments(spark, f"file://{tmp_path}/a.json")
    r = d.first()
    assert d.count() == 1 and (r.passage_text, r.probabilities, r.evidence_spans, r.metadata) == ("", {"x": 0.5}, [], {})
    records.write_assignments(d, f"file://{tmp_path}/out")
    assert records.read_assignments(spark, f"file://{tmp_path}/out").collect() == d.collect()
    assert records.read_assignments(spark, f"file://{tmp_path}/none").count() == 0


def test_classifications_leave_no_stale_documents(spark, tmp_path):
    schema, path = "doc_id string, label string", f"file://{tmp_path}/c"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    records.write_classifications(make(("a", "1"), ("b", "1"), (None, "x"), ("", "x")), path)
    records.write_classifications(make(("b", "2"), ("c", "2")), path)
    (tmp_path / "c" / "broken.json").write_text('{"doc_id": "z"')
    got = lambda **o: sorted(map(tuple, records.read_classifications(spark, path, schema, **o).collect()))
    assert got() == [("b", "2"), ("c", "2")]
    assert got(ids=make(("c", None), ("q", None))) == [("c", "2")]


def test_validation_samples(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"text_a": "a", "text_b": "b", "gold_label": "entails", "sample_id": "k"}, {"text_a": "c", "text_b": "d", "gold_label": "neutral"}]))
    (tmp_path / "s.csv").write_text('text_a,text_b,gold_label\n"one, ""two""",b,entails\nx,y,odd\n')
    d = records.read_samples(spark, f"file://{tmp_path}/s.json", ["entails", "neutral"])
    assert [(r.sample_id, r.text_a, r.metadata) for r in d.collect()] == [("k", "a", {}), ("sample_1", "c", {})]
    c = records.read_samples(spark, f"file://{tmp_path}/s.csv")
    assert [(r.sample_id, r.text_a, r.gold_label) for r in c.collect()] == [("sample_0", 'one, "two"', "entails"), ("sample_1", "x", "odd")]
    with pytest.raises(Exception, match="unknown label: odd"):
        records.read_samples(spark, f"file://{tmp_path}/s.csv", ["entails"]).collect()
    with pytest.raises(ValueError):
        records.read_samples(spark, "s.txt")


def test_manifest_and_corpus_info(spark, tmp_path):
    path = f"file://{tmp_path}"
    assert records.read_manifest(spark, path) == {}
    (tmp_path / "index.jsonl").write_text('{"id": "a"}\n\nbroken\n{"id": "a"}\n')
    assert records.corpus_info(spark, path).first().asDict() == {"corpus_path": path, "document_count": 3, "manifest": {}}
    records.write_manifest(spark, path, {"name": "é", "sources": ["a"]})
    assert records.read_manifest(spark, path) == {"name": "é", "sources": ["a"]}
    assert records.corpus_info(spark, path).first().manifest == {"name": "é", "sources": '["a"]'}


def test_document_aggregates(spark, tmp_path):
    path = f"file://{tmp_path}"
    (tmp_path / "frame_assignments.json").write_text(json.dumps([{"passage_id": "d:1", "passage_text": "abcd", "probabilities": {"x": 0.5}}, {"passage_id": "d:2", "passage_text": "ab", "probabilities": {"x": 1, "y": 1}}, {"passage_id": "e"}]))
    got = {r.doc_id: (r.frame_scores, r.total_weight) for r in records.document_aggregates(spark, path).collect()}
    assert got == {"d": ({"x": 4.0, "y": 2.0}, 6.0), "e": ({}, 0.0)}
    (tmp_path / "aggregates").mkdir()
    (tmp_path / "aggregates" / "documents_weighted.json").write_text(json.dumps([{"doc_id": "q", "frame_scores": {"x": 1}, "total_weight": 2}]))
    assert [r.doc_id for r in records.document_aggregates(spark, path).collect()] == ["q"]
