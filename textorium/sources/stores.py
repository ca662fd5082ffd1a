"""What is derived from documents (chunks, vectors, scores), kept on files and made only where it is missing.

A store holds parts. A run writes its rows and then its state, a row per key with the fingerprint that the rows were made from, their number and
a checksum, into folders of its own; one line in `commits` makes both visible, so a run that fails half-way
leaves nothing to be read. Keys are found missing by an anti-join with the state, never by looking for files one by one. The newest
part of a key counts.

Cases: a key without rows (an empty text) has a state and isn't made again; a key that comes twice in a run is made from both of its rows;
a null key is never stored; damaged or lost files make their own keys count as missing when `verify` is set.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "part string, spec string, version long, replaces array<string>"


class Store:
    """Rows by specification and key below a folder (any Hadoop path)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        spark.createDataFrame([], COMMIT).write.mode("ignore").json(f"{self.path}/commits")

    def parts(self, spec: str) -> list[tuple[str, int]]:
        """Parts of a specification that are committed and not replaced, with their versions; a few for each run."""
        c = self.spark.read.schema(COMMIT).json(f"{self.path}/commits").filter(F.col("spec") == spec)
        gone = c.select(F.explode("replaces").alias("part"))
        return [(r.part, r.version) for r in c.join(gone, "part", "left_anti").orderBy("version", "part").collect()]

    def _read(self, kind: str, parts: list[str], tolerant: bool = False) -> DataFrame:
        read = self.spark.read.option("ignoreCorruptFiles", tolerant).option("ignoreMissingFiles", tolerant)
        d = read.schema(self.spark.read.parquet(f"{self.path}/schema/{kind}/{parts[-1]}").schema).parquet(*(f"{self.path}/{kind}/{p}" for p in parts))
        return d

    def state(self, spec: str) -> DataFrame | None:
        """(key, fingerprint, n, check, version, part): what each key was last made from; None before the first run."""
        parts = [p for p, _ in self.parts(spec)]
        if not parts:
            return None
        s = self._read("state", parts)
        last = F.max_by(F.struct("fingerprint", "n", "check", "version", "part"), F.struct("version", "part"))
        return s.groupBy(self.key).agg(last.alias("s")).select(self.key, "s.*")

    def rows(self, spec: str, tolerant: bool = False) -> DataFrame:
        """The rows of all keys as they were last made; keys that were never made are simply not there."""
        parts = [p for p, _ in self.parts(spec)]
        if not parts:
            raise LookupError(f"nothing is stored for {spec}")
        return self._read("data", parts, tolerant).join(self.state(spec).select(self.key, "part"), [self.key, "part"], "left_semi").drop("part")

    def _checked(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*(c for c in sorted(rows.columns) if c != "part"))).alias("check"))

    def damaged(self, spec: str) -> DataFrame:
        """(key): keys whose rows can't all be read as they were written."""
        whole = self._checked(self.rows(spec, tolerant=True)).withColumnsRenamed({"n": "_n", "check": "_check"})
        s = self.state(spec).join(whole, self.key, "left")
        return s.filter((F.col("n") != F.coalesce("_n", F.lit(0))) | ~F.coalesce("check", F.lit(0)).eqNullSafe(F.coalesce("_check", F.lit(0)))).select(self.key)

    def missing(self, items: DataFrame, spec: str, fingerprint: str = "fingerprint", verify: bool = False) -> DataFrame:
        """The items (key, fingerprint, ...) that have no rows, rows of another fingerprint, or, with verify, damaged ones."""
        items, state = items.filter(F.col(self.key).isNotNull()), self.state(spec)
        if state is None:
            return items
        if verify:
            state = state.join(self.damaged(spec), self.key, "left_anti")
        have = state.select(self.key, F.col("fingerprint").alias("_have"))
        return items.join(have, (items[self.key] == have[self.key]) & items[fingerprint].eqNullSafe(have["_have"]), "left_anti")

    def put(self, items: DataFrame, rows: DataFrame, spec: str, fingerprint: str = "fingerprint", replaces: list[str] | None = None) -> str:
        """Stores the rows of the items as one part: rows, then states, then the commit. The part's name."""
        part, version = uuid.uuid4().hex, max((v for _, v in self.parts(spec)), default=0) + 1
        rows.withColumn("part", F.lit(part)).write.parquet(f"{self.path}/data/{part}")
        written = self.spark.read.parquet(f"{self.path}/data/{part}")
        s = items.groupBy(self.key).agg(F.max(fingerprint).alias("fingerprint")).join(self._checked(written), self.key, "left")
        s = s.select(self.key, "fingerprint", F.coalesce("n", F.lit(0)).alias("n"), "check", F.lit(version).cast("long").alias("version"), F.lit(part).alias("part"))
        s.write.parquet(f"{self.path}/state/{part}")
        for kind, d in (("data", written), ("state", s)):  # a part whose files are all damaged still has its columns
            d.limit(0).write.parquet(f"{self.path}/schema/{kind}/{part}")
        self.spark.createDataFrame([(part, spec, version, replaces or [])], COMMIT).coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return part

    def materialise(
        self, items: DataFrame, spec: str, make: Callable[[DataFrame], DataFrame], fingerprint: str = "fingerprint",
        allow_new: bool = True, reload: bool = True, verify: bool = False,
    ) -> DataFrame:
        """The rows of the items, of which those that are missing are made first, by make(missing items) -> (key, ...).

        allow_new=False: only what is there; reload=False: all items are made anew.
        """
        if allow_new:
            new = self.missing(items, spec, fingerprint, verify) if reload else items.filter(F.col(self.key).isNotNull())
            if not self.parts(spec) or not new.isEmpty():
                self.put(new, make(new), spec, fingerprint)
        return self.rows(spec, tolerant=verify).join(items.select(self.key).distinct(), self.key, "left_semi")

    def compact(self, spec: str) -> None:
        """All current rows as one part; the parts before are no longer read."""
        old = [p for p, _ in self.parts(spec)]
        if len(old) > 1:
            self.put(self.state(spec), self.rows(spec), spec, replaces=old)

    def stats(self, items: DataFrame, spec: str) -> DataFrame:
        """One row: documents, those of them that are available, rows, share."""
        state = self.state(spec)
        d = items.select(self.key).distinct()
        d = d.join(state.select(self.key, "n"), self.key, "left") if state is not None else d.withColumn("n", F.lit(None).cast("long"))
        return d.agg(F.count("*").alias("documents"), F.count("n").alias("available"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.try_divide(F.count("n"), F.count("*")).alias("share"))


def fingerprinted(docs: DataFrame, *columns: str) -> DataFrame:
    """With the content's SHA-1 as fingerprint."""
    return docs.withColumn("fingerprint", F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def embedded(docs: DataFrame, chunks: Store, vectors: Store, chunker: str, embedder: str, chunk: Callable, embed: Callable, **options) -> DataFrame:
    """Vectors of the documents' chunks: chunks are made where missing, then the vectors of those documents that lack them.

    chunk(docs) -> (key, chunk_id, chunk); embed(chunks) -> (key, chunk_id, vector).
    """
    chunks.materialise(docs, chunker, chunk, **options)
    key = chunks.key
    own = lambda new: embed(chunks.rows(chunker).join(new.select(key).distinct(), key, "left_semi"))
    return vectors.materialise(docs, f"{chunker}/{embedder}", own, **options)


def index_rows(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, vector) of the vectors that exist: the document, `_chunk_` and the chunk's number; empty vectors are left out."""
    return vectors.filter(F.size("vector") > 0).select(F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_id")).alias("id"), "vector")
