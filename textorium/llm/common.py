"""What the operators share: words, scans, and written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import released, table, written  # noqa: F401  shared with the rest of the library

#: White space of the word rule: space and the control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column | str) -> Column:
    """Words between runs of white space; an empty array for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def as_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones never clash with an operator's own."""
    return docs.select(*columns)


def by_key(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Frames of a sorted partition that hold all rows of each of their keys."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        last = (b[list(keys)] == b[list(keys)].iloc[-1]).all(axis=1)
        yield b[~last]
        held = b[last]
    if held is not None:
        yield held
