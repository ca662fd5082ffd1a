"""Fetching with a store of bodies: each body once, under its hash, and for each address what it takes to ask whether it has changed.

A request carries the validators of the last answer (ETag, date). An answer 304 stands for the old body; any other body is stored unless
its hash is there. The call is the caller's: fetch(url, etag, modified) -> (status, body or None, etag, modified).

Cases: a failing call is a row with its error and keeps what was known of the address; a 304 for an unknown address is an error; equal bodies of
different addresses are one blob; an address that is asked for twice in a run is fetched once; null addresses are left out.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written

BLOB, KNOWN = "hash string, body binary", "url string, etag string, modified string, hash string, status int, at timestamp"
ANSWER = "url string, status int, body binary, etag string, modified string, error string"


class BlobStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for kind, schema in (("blobs", BLOB), ("known", KNOWN)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{kind}")

    def blobs(self) -> DataFrame:
        return self.spark.read.schema(BLOB).parquet(f"{self.path}/blobs")

    def known(self) -> DataFrame:
        """(url, etag, modified, hash, status, at): the last good answer of each address."""
        k = self.spark.read.schema(KNOWN).parquet(f"{self.path}/known")
        return k.groupBy("url").agg(F.max_by(F.struct("etag", "modified", "hash", "status", "at"), "at").alias("k")).select("url", "k.*")

    def bodies(self, urls: DataFrame | None = None) -> DataFrame:
        """(url, hash, body) of the addresses, or of all that are known."""
        k = self.known().select("url", "hash")
        return (k if urls is None else k.join(urls.select("url").distinct(), "url", "left_semi")).join(self.blobs(), "hash").select("url", "hash", "body")

    def refresh(self, urls: DataFrame, fetch: Callable, retries: int = 2, pause: float = 0.0, parallel: int | None = None, max_age: str | None = None) -> DataFrame:
        """Asks for the addresses, all or those whose last answer is older; (url, outcome, error): new, changed, same, fresh or failed."""

        def run(batches):
            for b in batches:
                rows = []
                for url, etag, modified in zip(b["url"], b["etag"], b["modified"]):
                    etag, modified = (None if pd.isna(x) else x for x in (etag, modified))
                    row = None
                    for attempt in range(retries + 1):
                        try:
                            row = (url, *fetch(url, etag, modified), None)
                            break
                        except Exception as e:  # the row carries it
                            row = (url, None, None, None, None, f"{type(e).__name__}: {e}")
                            time.sleep(pause * 2**attempt)
                    rows.append(row)
                yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("url", "status", "body", "etag", "modified", "error"))})

        known = written(self.known(), "known")
        asked = urls.filter("url is not null").select("url").distinct().join(known, "url", "left")
        fresh = F.lit(False) if max_age is None else F.coalesce(F.col("at") >= F.current_timestamp() - F.expr(f"interval {max_age}"), F.lit(False))
        now = written(asked.withColumn("fresh", fresh), "asked")
        ask = now.filter("not fresh").select("url", "etag", "modified")
        answers = (ask.repartition(parallel, "url") if parallel else ask).mapInPandas(run, ANSWER)
        a = written(answers.withColumn("new_hash", F.sha2("body", 256)), "answers")
        a = a.join(now.select("url", F.col("hash").alias("old_hash"), F.col("etag").alias("old_etag"), F.col("modified").alias("old_modified")), "url")
        same = F.coalesce(F.col("status") == 304, F.lit(False))
        a = a.withColumn("hash", F.when(same, F.col("old_hash")).when(F.col("error").isNull() & F.col("status").between(200, 299), F.col("new_hash")))
        a = a.withColumn("error", F.coalesce("error", F.when(F.col("hash").isNull(), F.concat(F.lit("status "), F.col("status")))))
        good = a.filter("hash is not null")
        new = good.filter(~same).select("hash", "body").join(self.blobs().select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
        written(new, "new-blobs").write.mode("append").option("compression", "zstd").parquet(f"{self.path}/blobs")
        kept = lambda c: F.when(same, F.coalesce(c, f"old_{c}")).otherwise(F.col(c)).alias(c)
        good.select("url", kept("etag"), kept("modified"), "hash", "status", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}/known")
        outcome = F.when(F.col("hash").isNull(), "failed").when(F.col("old_hash").isNull(), "new").when(F.col("hash") == F.col("old_hash"), "same").otherwise("changed")
        return a.select("url", outcome.alias("outcome"), "error").unionByName(now.filter("fresh").select("url", F.lit("fresh").alias("outcome"), F.lit(None).cast("string").alias("error")))
