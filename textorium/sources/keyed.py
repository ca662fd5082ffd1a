"""Tables that are upserted by key: buckets by the key's hash, of which an upsert rewrites only those it touches.

A bucket's rows, its index (key to id and number of findings) and its counts are written as a new generation beside the old one; a
manifest says which generation of each bucket counts. Its last lines are the commit, so readers see an upsert whole or not at all.

Cases: of new rows with one key the last by `order` stays; null keys are left out; an upsert of no rows changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_by

MANIFEST = "bucket int, generation string, version long, rows long, findings long"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "url", id_col: str = "doc_id", items: str = "findings", buckets: int = 64):
        self.spark, self.path, self.key, self.id_col, self.items, self.buckets = spark, path.rstrip("/"), key, id_col, items, buckets
        spark.createDataFrame([], MANIFEST).write.mode("ignore").json(f"{self.path}/manifest")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> DataFrame:
        """(bucket, generation, version, rows, findings): what counts now; a row per bucket."""
        m = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        return m.groupBy("bucket").agg(F.max_by(F.struct("generation", "version", "rows", "findings"), "version").alias("m")).select("bucket", "m.*")

    def _read(self, kind: str, current: Sequence) -> DataFrame | None:
        paths = [f"{self.path}/{kind}/{r.generation}/bucket={r.bucket}" for r in current]
        return self.spark.read.parquet(*paths) if paths else None

    def rows(self, keys: DataFrame | None = None) -> DataFrame | None:
        """All rows, or those of the keys, whose buckets alone are read; None while nothing is stored."""
        return self._looked_up("rows", keys)

    def index(self, keys: DataFrame | None = None) -> DataFrame | None:
        """(key, id, n): where each key is and how much was found for it, without reading rows."""
        return self._looked_up("index", keys)

    def _looked_up(self, kind: str, keys: DataFrame | None) -> DataFrame | None:
        current = self.manifest().collect()
        if keys is not None:
            own = {r.b for r in keys.select(self.bucket().alias("b")).distinct().collect()}
            current = [r for r in current if r.bucket in own]
        d = self._read(kind, [r for r in current if r.rows])
        return d if d is None or keys is None else d.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def counts(self) -> DataFrame:
        """One row: documents and findings, from the manifest alone."""
        m = self.manifest()
        return m.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("documents"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))

    def upsert(self, new: DataFrame, order: str | None = None) -> list[int]:
        """Stores the rows, which take the place of those with their keys. The buckets that were rewritten."""
        new = new.filter(F.col(self.key).isNotNull())
        new = first_by(new, [self.key], F.desc(order)) if order else new.dropDuplicates([self.key])
        touched = sorted(r.b for r in new.select(self.bucket().alias("b")).distinct().collect())
        if not touched:
            return []
        current = [r for r in self.manifest().collect()]
        version, generation = max((r.version for r in current), default=0) + 1, uuid.uuid4().hex
        old = self._read("rows", [r for r in current if r.bucket in touched and r.rows])
        both = new if old is None else old.join(new.select(self.key), self.key, "left_anti").unionByName(new, allowMissingColumns=True)
        both.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/{generation}")
        stored = self.spark.read.parquet(f"{self.path}/rows/{generation}")
        n = F.coalesce(F.size(self.items), F.lit(0)) if self.items in stored.columns else F.lit(0)
        index = stored.select(self.key, self.id_col, n.cast("long").alias("n"), "bucket")
        index.write.partitionBy("bucket").parquet(f"{self.path}/index/{generation}")
        m = index.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("n").alias("findings"))
        m = m.select(F.col("bucket").cast("int"), F.lit(generation).alias("generation"), F.lit(version).cast("long").alias("version"), "rows", "findings")
        m.coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return touched


def first_to_find(items: DataFrame, key: str, extractors: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], result: str = "findings") -> DataFrame:
    """(items' columns, result, extractor, error): each item with what the first extractor that finds something finds.

    An extractor takes items and gives (key, result, error) of those it can read. Only what none before has found goes to the next; what no
    one finds has an empty result, no extractor, and the last error.
    """
    found, rest = None, items.withColumn("error", F.lit(None).cast("string"))
    kind = None
    for name, extract in extractors:
        out = extract(rest.drop("error")).select(key, F.col(result), F.col("error").alias("_error"))
        kind = out.schema[result].dataType
        d = rest.join(out, key, "left")
        d = d.withColumn("error", F.coalesce("_error", "error")).drop("_error").withColumn("_has", F.coalesce(F.size(result), F.lit(0)) > 0)
        own = d.filter("_has").withColumn("extractor", F.lit(name)).withColumn("error", F.lit(None).cast("string")).drop("_has")
        found = own if found is None else found.unionByName(own)
        rest = d.filter("not _has").drop("_has", result)
    rest = rest.withColumn(result, F.array().cast(kind)).withColumn("extractor", F.lit(None).cast("string"))
    return found.unionByName(rest).select(*items.columns, result, "extractor", "error")


def rates(built: DataFrame, result: str = "findings") -> DataFrame:
    """(extractor, documents, share, mean_findings) of each extractor, null for what none could read."""
    total = built.agg(F.count("*").alias("_all"))
    g = built.groupBy("extractor").agg(F.count("*").alias("documents"), F.avg(F.size(result)).alias("mean_findings"))
    return g.crossJoin(total).select("extractor", "documents", (F.col("documents") / F.col("_all")).alias("share"), "mean_findings")
