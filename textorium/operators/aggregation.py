"""Aggregation by a user's own strategy: accumulate, merge, finalize, in partial states that meet by key.

A task accumulates its rows batch by batch into one state per key, however many rows a key has; only states are dealt by key, merged as
they come and finalized. No group of rows is ever in one place.

Cases: null keys are a group; a key whose rows a strategy ignores still has a state; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that a task or a merge holds before they are brought together.
HELD = 1 << 16


class Strategy:
    """`state` and `result` are DDL of the columns of a state and of a result. Frames have a column `key`, which is to be kept.

    accumulate: rows to states; merge: several states of a key to one; finalize: states to results.
    """

    state: str
    result: str

    def accumulate(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def merge(self, states: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def finalize(self, states: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError


def aggregate(rows: DataFrame, keys: Sequence[str], strategy: Strategy) -> DataFrame:
    """(keys, result columns): a row per key. The strategy sees all columns of rows that aren't keys."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            if len(b):
                held.append(strategy.accumulate(b))
                n += len(held[-1])
            if n >= HELD and len(held) > 1:
                m = strategy.merge(pd.concat(held, ignore_index=True))
                held, n = [m], len(m)
                if 2 * n >= HELD:  # hardly any key comes again
                    yield m
                    held, n = [], 0
        if held:
            yield strategy.merge(pd.concat(held, ignore_index=True))

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Over states in order of key: all but the last key of what is held are whole."""
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= HELD:
                m = strategy.merge(pd.concat(held, ignore_index=True))
                last = m["key"] == b["key"].iloc[-1]
                yield strategy.finalize(m[~last].reset_index(drop=True))
                held, n = [m[last]], 1
        if n:
            yield strategy.finalize(strategy.merge(pd.concat(held, ignore_index=True)))

    kind = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    rest = [c for c in rows.columns if c not in keys]
    d = rows.select(F.to_json(F.struct(*keys)).alias("key"), *rest).mapInPandas(partial, f"key string, {strategy.state}")
    d = d.repartition("key").sortWithinPartitions("key").mapInPandas(final, f"key string, {strategy.result}")
    return d.withColumn("_k", F.from_json("key", kind)).select("_k.*", *(c for c in d.columns if c != "key"))


def _by_key(frame: pd.DataFrame) -> tuple[np.ndarray, pd.Index]:
    codes, keys = pd.factorize(frame["key"])
    return codes, keys


def _stacked(arrays: pd.Series, n: int) -> np.ndarray:
    return np.stack(arrays.to_numpy()) if len(arrays) else np.zeros((0, n))


class FrameScores(Strategy):
    """Rows (frame_idx, p, w) to one value a frame, as arrays by frame_idx: subclasses say what a row adds and what comes out."""

    state, result = "sums array<double>, weights array<double>", "`values` array<double>, total_weight double, any_value boolean"

    def __init__(self, frames: int, threshold: float = 0.0):
        self.frames, self.threshold = frames, threshold

    def added(self, p: np.ndarray, w: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def joined(self, codes: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, values.shape[1]))
        np.add.at(out, codes, values)
        return out

    def accumulate(self, rows):
        codes, keys = _by_key(rows)
        p, w, i = (rows[c].to_numpy() for c in ("p", "w", "frame_idx"))
        sums, weights = np.zeros((len(rows), self.frames)), np.zeros((len(rows), self.frames))
        sums[np.arange(len(rows)), i] = self.added(p, w)
        weights[np.arange(len(rows)), i] = w
        return self._frame(keys, self.joined(codes, sums, len(keys)), FrameScores.joined(self, codes, weights, len(keys)))

    def merge(self, states):
        codes, keys = _by_key(states)
        sums, weights = (_stacked(states[c], self.frames) for c in ("sums", "weights"))
        return self._frame(keys, self.joined(codes, sums, len(keys)), FrameScores.joined(self, codes, weights, len(keys)))

    @staticmethod
    def _frame(keys, sums, weights):
        return pd.DataFrame({"key": np.asarray(keys, dtype=object), "sums": list(sums), "weights": list(weights)})


class Weighted(FrameScores):
    """Words-weighted means, scaled to sum 1; what is under the threshold counts as 0."""

    def added(self, p, w):
        return np.where((self.threshold <= 0) | (p >= self.threshold), w * p, 0.0)

    def finalize(self, states):
        sums, weights = (_stacked(states[c], self.frames) for c in ("sums", "weights"))
        v = np.divide(sums, weights, out=np.zeros_like(sums), where=weights > 0)
        total = v.sum(axis=1)
        v = np.where(total[:, None] > 0, v / np.where(total > 0, total, 1)[:, None], v)
        return pd.DataFrame({"key": states["key"], "values": list(v), "total_weight": weights.max(axis=1), "any_value": total > 0})


class Occurring(FrameScores):
    """1 for a frame that any row has at the threshold and over 0."""

    def added(self, p, w):
        return ((p >= self.threshold) & (p > 0)).astype(float)

    def joined(self, codes, values, n):
        out = np.zeros((n, values.shape[1]))
        np.maximum.at(out, codes, values)
        return out

    def finalize(self, states):
        v = _stacked(states["sums"], self.frames)
        return pd.DataFrame({"key": states["key"], "values": list(v), "total_weight": 1.0, "any_value": v.max(axis=1) > 0})


def by_frame(result: DataFrame, keys: Sequence[str], frames: Sequence[str]) -> DataFrame:
    """(keys, frame_idx, frame, value, total_weight, any_value): array results in the long form."""
    d = result.select(*keys, "total_weight", "any_value", F.posexplode("values").alias("frame_idx", "value"))
    return d.select(*keys, "frame_idx", F.array(*map(F.lit, frames))[F.col("frame_idx")].alias("frame"), "value", "total_weight", "any_value")
