"""Row predicates, as Columns, and the filter split of a pipeline."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_match


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def metadata(field: Column | str, value, op: str = "eq") -> Column:
    """Comparison with a metadata field; a missing value is false for every operator, `ne` too."""
    c = _col(field)
    ops = {
        "eq": lambda: c == value, "ne": lambda: c != value, "gt": lambda: c > value, "lt": lambda: c < value,
        "gte": lambda: c >= value, "lte": lambda: c <= value, "in": lambda: c.isin(list(value)), "contains": lambda: c.contains(value),
    }
    if op not in ops:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(ops[op](), F.lit(False))


def every(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def since(date: Column | str, least: str) -> Column:
    """A missing date is dropped."""
    return F.coalesce(_col(date) >= least, F.lit(False))


def lenient_between(date: Column | str, least, most) -> Column:
    """A missing date passes."""
    return F.coalesce(_col(date).between(least, most), F.lit(True))


def lenient_confidence(c: Column | str, least: float) -> Column:
    """A missing or zero confidence passes."""
    return _col(c).isNull() | (_col(c) == 0) | (_col(c) >= least)


def strict_confidence(c: Column | str, least: float) -> Column:
    """A missing or zero confidence fails."""
    return F.coalesce((_col(c) != 0) & (_col(c) >= least), F.lit(False))


def relevance(text: Column | str, language: Column | str, keywords: dict[str, list[str]]) -> Column:
    """Whether a text has a keyword of its language (or of the language before a hyphen); without keywords it has."""
    lang = F.lower(_col(language))
    short = F.split_part(lang, F.lit("-"), F.lit(1))
    out = F.lit(True)
    for k, words in keywords.items():
        hit = reduce(lambda a, b: a | b, (keyword_match(text, w) for w in words), F.lit(False))
        out = F.when((lang == k) | (short == k), hit).otherwise(out)
    return out


def split(rows: DataFrame, predicate: Column) -> DataFrame:
    """Adds `passed`; an unknown outcome is a failure."""
    return rows.withColumn("passed", F.coalesce(predicate, F.lit(False)))


def counts(rows: DataFrame) -> DataFrame:
    """One row: total, passed, failed, success in percent."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        (100 * F.count_if("passed") / F.count("*")).alias("success"),
    )


def captured(rows: DataFrame, column: str, step: Callable, result: str = "string") -> DataFrame:
    """Rows with `result` and `error`: step(value) of each, or what it raised as `Type: message`; no row fails the job."""

    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((step(v), None))
            except Exception as e:  # the row carries it
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(("result", "error"))})

    done = F.pandas_udf(run, f"result {result}, error string")
    return rows.withColumn("_done", done(column)).select(*rows.columns, "_done.result", "_done.error")
