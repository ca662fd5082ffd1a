"""The stream's frontier against the batch operators on the same events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from textorium.operators import incremental
from textorium.streaming import frontier

T0 = datetime(2024, 1, 1)
EVENT = "url string, at timestamp, fingerprint string, failed boolean"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, batches, **options):
    """Each batch is a file and a trigger."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows = []
    q = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    s = frontier.frontier(q, "url", "at", "fingerprint", "failed", **options).writeStream.outputMode("append")
    s = s.option("checkpointLocation", f"{folder}/check").foreachBatch(lambda d, i: rows.extend(map(tuple, d.collect()))).trigger(availableNow=True).start()
    s.awaitTermination(200)
    return sorted(rows, key=str)


def plainly(events, live, memory):
    known, out = {}, []
    for url, at, f, failed in sorted(events, key=lambda e: (e[1], e[2] or "")):
        k = known.get(url)
        if k and at >= k[1] + (memory if k[2] else live) and k[2]:
            k = None
        if failed:
            known[url] = (f, at, True)
            out.append((url, "failed", at, f))
        elif k and k[2]:
            continue
        elif k is None or k[0] != f or at >= k[1] + live:
            out.append((url, "new" if k is None else "changed" if k[0] != f else "expired", at, f))
            known[url] = (f, at, False)
    return sorted(out, key=str)


def test_actions_equal_a_plain_pass_over_all_events(spark, tmp_path):
    rng = random.Random(3)
    at, batches = T0, []
    for _ in range(5):
        b = []
        for _ in range(40):
            at += timedelta(minutes=rng.randrange(1, 90))
            b.append((f"u{rng.randrange(12)}", at, rng.choice("ab"), rng.random() < 0.15))
        batches.append(b)
    got = run(spark, tmp_path, batches, live="12 hours", memory="30 hours", late="40 days")
    assert got == plainly([e for b in batches for e in b], timedelta(hours=12), timedelta(hours=30))


def test_agrees_with_the_batch_frontier_and_rebuilds(spark, tmp_path):
    stored = [(f"u{i}", T0, f"f{i}", False) for i in range(20)]
    failed = [(f"u{i}", T0, "x", True) for i in range(20, 25)]
    later = [(f"u{i}", T0 + timedelta(days=1), "f0" if i % 3 == 0 else f"f{i}", False) for i in range(30)]
    got = run(spark, tmp_path, [stored + failed, later])
    day2 = {(u, a) for u, a, at, _ in got if at > T0}
    d = spark.createDataFrame(later, EVENT)
    s, f = spark.createDataFrame(stored, EVENT), spark.createDataFrame(failed, EVENT)
    new = {r.url for r in incremental.frontier(d, s, f, "url").collect()}
    changed = {r.url for r in incremental.needs_rebuild(d.join(s, "url", "left_semi"), s, "url", ["fingerprint"]).collect()}
    assert day2 == {(u, "new") for u in new} | {(u, "changed") for u in changed}


def test_a_key_is_forgotten_after_its_time_to_live(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    batches = [[("a", at(0), "1", False)], [("b", at(30), "1", False)], [("b", at(31), "1", False)], [("a", at(32), "1", False)]]
    got = run(spark, tmp_path, batches, live="12 hours", late="1 hour")
    assert [(u, a) for u, a, _, _ in got] == [("a", "new"), ("a", "new"), ("b", "new")]  # not `expired`: the timer has cleared it
