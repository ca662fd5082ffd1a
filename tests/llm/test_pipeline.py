"""The whole pipeline on a small corpus with planted cases, each stage held against what it was planted for."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from textorium.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, _text string"
FORMS = {"xx": "kra mol tip senn gort blin drask vum", "yy": "oua eli ésu amé iolé uani éao seia"}


def say(g, lang: str, n: int, per_line: int = 12) -> str:
    w = [f"{g.choice(FORMS[lang].split())}{g.choice(FORMS[lang].split())}" for _ in range(n)]
    return "\n".join(" ".join(w[i : i + per_line]) for i in range(0, n, per_line))


def corpus(spark, folder):
    g = np.random.default_rng(21)
    texts = {k: (say(g, "xx" if k % 2 else "yy", 90), "xx" if k % 2 else "yy") for k in range(160)}
    item = say(g, "xx", 30).replace("\n", " ")
    passage = say(g, "yy", 60)
    planted = {"clean": set(texts)}
    for k in range(10):
        texts[200 + k] = (texts[k][0] + "\nand one more", texts[k][1])  # a near copy of a clean one
        texts[300 + k] = (f"{say(g, 'xx', 30)} {item} {say(g, 'xx', 30)}", "xx")  # holds a benchmark item
        texts[400 + k] = (f"{say(g, 'yy', 40)}\n{passage}\n{say(g, 'yy', 40)}", "yy")  # shares a passage
    texts |= {500: (None, "xx"), 501: ("", None), 502: ("12 34 !!", "xx")}
    rows = [(i, t, y, f"s{i % 3}" if i % 7 else None, len(t or ""), "id", 1.0, "x") for i, (t, y) in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return planted["clean"], passage


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    clean, passage = corpus(spark, folder)
    docs, kept = table(spark, folder, "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage-{k}.parquet")
        docs = spark.read.parquet(f"{folder}/stage-{k}.parquet")
        if name != "sources":
            assert out.columns == table(spark, folder, "documents").columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "sources"]
    assert not {500, 501, 502} & kept["language"].keys() and len(kept["language"].keys() & clean) >= 0.97 * len(clean)
    holders = [kept["lines"][400 + k] for k in range(10)]
    assert [passage in t for t in holders] == [True] + [False] * 9
    # the near copies' own line is left of them once their passages are cut, or they go as copies
    assert not any(kept["near_copies"].get(200 + k, "").startswith(kept["language"][k][:50]) for k in range(10) if k in kept["language"])
    assert not {300 + k for k in range(10)} & kept["benchmark"].keys()
    assert clean & kept["near_copies"].keys() == clean & kept["benchmark"].keys()
    size = sum(len(t.split()) for t in kept["benchmark"].values())
    taken = docs.agg({"taken": "sum"}).first()[0]
    assert abs(taken - 1.5 * size) <= 64 * 4
    again = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in docs.collect())
