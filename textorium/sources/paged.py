"""Paged services as Spark sources: a partition for each query and window of days, pages read one after another within it.

The call is the caller's: fetch(query, first day, last day, token) -> (rows, next token or None), the first token None. A page that
fails is asked for again inside its partition, each time after a longer pause; when that doesn't help the task fails and Spark runs
the partition anew, from its first page, so that no row is kept twice or lost. As a stream, the days up to each trigger's
are an offset; a restarted query goes on from the last one committed.

Cases: days are inclusive, windows don't overlap; no queries or an empty range make no partition; a row's missing fields are null;
a token that comes back within a partition ends it with an error rather than going round.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

DAY = timedelta(days=1)


class Window(InputPartition):
    def __init__(self, query: str, first: str, last: str):
        self.query, self.first, self.last = query, first, last


def windows(queries: Sequence[str], first: date, last: date, days: int) -> list[Window]:
    """Every query's windows of so many days, first to last day inclusive."""
    out, a = [], first
    while a <= last:
        b = min(a + DAY * (days - 1), last)
        out += [Window(q, a.isoformat(), b.isoformat()) for q in queries]
        a = b + DAY
    return out


def pages(fetch: Callable, w: Window, retries: int, pause: float) -> Iterator[list[dict]]:
    """The pages of one window, in order."""
    token, seen = None, set()
    while True:
        for attempt in range(retries + 1):
            try:
                rows, following = fetch(w.query, w.first, w.last, token)
                break
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(pause * 2**attempt)
        yield rows
        if following is None:
            return
        if following in seen:
            raise RuntimeError(f"{w.query} {w.first}: page {following!r} came again")
        seen.add(following)
        token = following


class _Reads:
    """What batch and stream readers share: options, and rows of a window in the schema's order."""

    def __init__(self, fetch: Callable, schema: StructType, options):
        self.fetch, self.names, self.options = fetch, [f.name for f in schema.fields], dict(options)

    def _of(self, name: str, default: str) -> str:
        return {k.lower(): v for k, v in self.options.items()}.get(name, default)

    def _windows(self, first: str, last: str) -> list[Window]:
        return windows(json.loads(self._of("queries", "[]")), date.fromisoformat(first), date.fromisoformat(last), int(self._of("days", "7")))

    def read(self, partition: Window | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        own = {"query": partition.query}
        for page in pages(self.fetch, partition, int(self._of("retries", "3")), float(self._of("pause", "0.5"))):
            for row in page:
                row = own | row
                yield tuple(row.get(n) for n in self.names)


class _Batch(_Reads, DataSourceReader):
    def partitions(self) -> list[Window]:
        return self._windows(self._of("first", ""), self._of("last", ""))


class _Stream(_Reads, DataSourceStreamReader):
    """An offset is the next day to read."""

    def __init__(self, fetch, schema, options, today: Callable[[], str]):
        super().__init__(fetch, schema, options)
        self.today = today

    def initialOffset(self) -> dict:
        return {"next": self._of("first", "")}

    def latestOffset(self) -> dict:
        return {"next": (date.fromisoformat(self.today()) + DAY).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        return self._windows(start["next"], (date.fromisoformat(end["next"]) - DAY).isoformat())

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, name: str, fetch: Callable, schema: str, today: Callable[[], str] = lambda: date.today().isoformat()) -> None:
    """Makes `name` a format of spark.read and spark.readStream; rows have the schema's fields, `query` among them if it is listed."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return _Batch(fetch, schema, self.options)

        def streamReader(self, schema):
            return _Stream(fetch, schema, self.options, today)

    spark.dataSource.register(Paged)


def search(spark: SparkSession, name: str, queries: Sequence[str], first: str, last: str, days: int = 7, **options) -> DataFrame:
    """The rows of all queries from the first to the last day."""
    read = spark.read.format(name).option("queries", json.dumps(list(queries))).option("first", first).option("last", last).option("days", days)
    return read.options(**options).load()


def follow(spark: SparkSession, name: str, queries: Sequence[str], first: str, days: int = 7, **options) -> DataFrame:
    """The same as a stream: each trigger reads the days that are new."""
    return spark.readStream.format(name).option("queries", json.dumps(list(queries))).option("first", first).option("days", days).options(**options).load()


def discovered(found: DataFrame, key: str = "url") -> DataFrame:
    """(key, ..., queries): each item once, with all queries that found it; its other columns are those of its smallest query."""
    rest = [c for c in found.columns if c not in (key, "query")]
    g = found.groupBy(key).agg(F.min(F.struct("query", *rest)).alias("_r"), F.sort_array(F.collect_set("query")).alias("queries"))
    return g.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest), "queries")


def link_pages(fetch: Callable[[str], str], pattern: str, following: str = r'rel="next"[^>]*href="([^"]+)"|href="([^"]+)"[^>]*rel="next"') -> Callable:
    """A fetch of listing pages: the query is the first page's address, rows are the links that match the pattern, the next page is the one that the page names."""
    import re

    link, on = re.compile(r'href="([^"#]+)'), re.compile(following)

    def fetch_page(query, first, last, token):
        html = fetch(token or query)
        at = on.search(html)
        own = [x for x in dict.fromkeys(link.findall(html)) if re.search(pattern, x)]
        return [{"url": x} for x in own], next((g for g in at.groups() if g), None) if at else None

    return fetch_page
