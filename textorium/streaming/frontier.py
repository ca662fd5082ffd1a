"""The frontier of a crawl as a stream with keyed state: what is new or changed, what is still fresh, what failed before.

Each key's state is one row: the fingerprint it was last taken with, when, and whether taking it failed. An event of a key is

- `failed` memory: skipped, for as long as failures are remembered, once it has been reported as failed;
- fresh: skipped, if its fingerprint is the known one and its time to live hasn't passed;
- taken otherwise, as `new`, `changed` or `expired`.

A timer forgets a key when neither its time to live nor its failure memory holds any longer, so that the state has the keys of that
time only. Batch twins: `incremental.frontier`, `needs_rebuild`, `fresh`.

Cases: events of a key are taken in order of time, then fingerprint, within a trigger; a null fingerprint is one like others; null keys are dropped;
a trigger without a key's events leaves its state as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "action string, at timestamp, fingerprint string"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"key": object, "action": object, "at": "datetime64[ns]", "fingerprint": object}
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=k) for i, (c, k) in enumerate(kinds.items())})


class Frontier(StatefulProcessor):
    def __init__(self, live_ms: int, memory_ms: int):
        self.live_ms, self.memory_ms = live_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "fingerprint string, at long, failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True)
        events["_f"] = events["fingerprint"].fillna("")
        events = events.sort_values(["at", "_f"], kind="stable")
        known = tuple(self.known.get()) if self.known.exists() else None
        out = []
        for at, fingerprint, failed in zip(events["at"], events["fingerprint"], events["failed"]):
            ms = int(at.timestamp() * 1000)
            if bool(failed):
                known = (fingerprint, ms, True)
                out.append(("failed", at, fingerprint))
                continue
            if known and known[2] and ms < known[1] + self.memory_ms:
                continue
            if known is None or known[2]:
                action = "new"
            elif known[0] != fingerprint:
                action = "changed"
            elif ms >= known[1] + self.live_ms:
                action = "expired"
            else:
                continue
            known = (fingerprint, ms, False)
            out.append((action, at, fingerprint))
        if out:
            self.known.update(known)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(known[1] + (self.memory_ms if known[2] else self.live_ms))
        yield _frame([(key[0], *o) for o in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        yield _frame([])

    def close(self) -> None:
        pass


def frontier(events: DataFrame, key: str, at: str, fingerprint: str, failed: str, live: str = "7 days", memory: str = "30 days", late: str = "1 hour") -> DataFrame:
    """(key, action, at, fingerprint): what to take of a stream of events, and the failures. Needs the RocksDB state store."""
    ms = lambda x: int(pd.Timedelta(x).total_seconds() * 1000)
    kind = events.schema[key].dataType.simpleString()
    e = events.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(fingerprint).cast("string").alias("fingerprint"), F.coalesce(failed, F.lit(False)).alias("failed"))
    e = e.filter("key is not null and at is not null").withWatermark("at", late)
    out = e.groupBy("key").transformWithStateInPandas(Frontier(ms(live), ms(memory)), f"key {kind}, {OUT}", "Append", "EventTime", eventTimeColumnName="at")
    return out.withColumnRenamed("key", key)
