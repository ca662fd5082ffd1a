"""Fetching as a DataFrame operator: requests in, answers out, a failure is a row.

The call itself is the caller's (`fetch(url) -> bytes | str`); here are paging, retries, gates and the cache join.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted

ANSWER = "url string, body string, error string, attempts int"


def compiled(queries: dict[str, Sequence[str]]) -> str:
    """Terms quoted and OR-ed within a language, languages OR-ed."""
    part = [" OR ".join(f'"{t}"' if " " in t else t for t in ts) for ts in queries.values() if ts]
    return " OR ".join(f"({p})" for p in part)


def fetched(requests: DataFrame, fetch: Callable[[str], str], retries: int = 2, delay: float = 0.0, parallel: int | None = None) -> DataFrame:
    """(url, body, error, attempts): one call a url, again on errors; no url fails the job."""

    def run(batches):
        for b in batches:
            rows = []
            for url in b["url"]:
                body = error = None
                for attempt in range(1, retries + 2):
                    try:
                        body, error = fetch(url), None
                        break
                    except Exception as e:  # the row carries it
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(delay)
                rows.append((url, body, error, attempt))
            yield pd.DataFrame(rows, columns=["url", "body", "error", "attempts"])

    d = requests.select("url")
    return (d.repartition(parallel, "url") if parallel else d).mapInPandas(run, ANSWER)


def with_cache(requests: DataFrame, cache: DataFrame, fetch: Callable[[str], str], **options) -> DataFrame:
    """Answers from the cache, and fresh ones for the rest."""
    hit = cache.join(requests.select("url"), "url", "left_semi").select("url", "body", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    return hit.unionByName(fetched(requests.join(cache.select("url"), "url", "left_anti"), fetch, **options))


def records(rows: DataFrame, header: Sequence[str], column: str = "row") -> DataFrame:
    """Rows as arrays under a header row, as maps."""
    return rows.select(F.map_from_arrays(F.array(*map(F.lit, header)), F.col(column)).alias("record"))


def election_rows(records_: DataFrame, countries: Sequence[str], years: Sequence[str]) -> DataFrame:
    """Records of a country (code or name, any case) and an election year (last part of DD/MM/YYYY, else the first four)."""
    at = lambda k: F.try_element_at("record", F.lit(k))
    wanted = [c.lower() for c in countries]
    year = F.when(at("edate").contains("/"), F.element_at(F.split(at("edate"), "/"), -1)).otherwise(F.substring(at("edate"), 1, 4))
    named: Column = F.lower(at("country")).isin(wanted) | F.lower(at("countryname")).isin(wanted)
    return records_.filter((F.lit(not wanted) | named) & (F.lit(not years) | year.isin(list(years))))


def links(pages: DataFrame, base: str, column: str = "html") -> DataFrame:
    """(url) of the links below base in pages."""
    found = F.regexp_extract_all(F.col(column), F.lit(rf'href="({quoted(base)}[^"#]*)'), F.lit(1))
    return pages.select(F.explode(found).alias("url")).distinct()
