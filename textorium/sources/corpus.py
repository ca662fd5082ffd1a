"""Corpus and library folders as tables: JSON-lines index, a folder per document, and Parquet behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import global_id
from ..operators.dedup import first_by

INDEX = "id string, url string, title string, published_at string, language string, content_hash string"
FINDING = "finding_id string, text string, confidence double, category string, keywords array<string>"
LIBRARY = f"doc_id string, url string, title string, published_at string, findings array<struct<{FINDING.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>"


def read_index(spark: SparkSession, path: str, schema: str = INDEX) -> DataFrame:
    """Rows of a JSON-lines index; blank and malformed lines and rows without an id are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.filter(F.col("_bad").isNull() & (F.coalesce("id", F.lit("")) != "")).drop("_bad")


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines that aren't blank, malformed ones and duplicates included."""
    return spark.read.text(path).filter(F.trim("value") != "").agg(F.count("*").alias("n"))


def latest_entries(index: DataFrame, order: str) -> DataFrame:
    """Of entries with the same id the last by `order`."""
    return first_by(index, ["id"], F.desc(order))


def _doc_of(path: Column) -> Column:
    return F.regexp_extract(path, r"/documents/([^/]+)/[^/]+$", 1)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of documents/<id>/text.txt."""
    t = spark.read.text(f"{path}/documents/*/text.txt", wholetext=True)
    return t.select(_doc_of(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def read_side_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(doc_id, map) of documents/<id>/<name>; a corrupt file is an empty map."""
    t = spark.read.text(f"{path}/documents/*/{name}", wholetext=True)
    m = F.from_json("value", "map<string,string>")
    return t.select(_doc_of(F.input_file_name()).alias("doc_id"), F.coalesce(m, F.expr("cast(map() as map<string,string>)")).alias("info"))


def merged_maps(low: Column, high: Column) -> Column:
    """Both maps' entries; the second wins."""
    low, high = (F.coalesce(m, F.expr("cast(map() as map<string,string>)")) for m in (low, high))
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)


def assemble(texts: DataFrame, meta: DataFrame, fetch: DataFrame) -> DataFrame:
    """Documents with metadata; what was fetched wins over what was given, the url is meta's uri or empty."""
    m, f = meta.select("doc_id", F.col("info").alias("_m")), fetch.select("doc_id", F.col("info").alias("_f"))
    d = texts.join(m, "doc_id", "left").join(f, "doc_id", "left").withColumn("meta", merged_maps(F.col("_m"), F.col("_f")))
    at = lambda k: F.try_element_at("meta", F.lit(k))
    url = F.coalesce(F.try_element_at("_m", F.lit("uri")), F.lit(""))
    return d.select("doc_id", url.alias("url"), at("title").alias("title"), "text", at("published_at").alias("published_at"), at("language").alias("language"), "meta")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return assemble(read_texts(spark, path), read_side_files(spark, path, "meta.json"), read_side_files(spark, path, "fetch.json"))


def union_corpora(corpora: dict[str, DataFrame], id_col: str = "doc_id") -> DataFrame:
    """One table with a corpus column; ids are prefixed when there are several corpora."""
    out = None
    for name, d in corpora.items():
        d = d.withColumn("corpus", F.lit(name))
        if len(corpora) > 1:
            d = d.withColumn(id_col, global_id(F.lit(name), F.col(id_col)))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def write_documents(docs: DataFrame, path: str, mode: str = "append", by: Sequence[str] = ("corpus",)) -> None:
    """Documents as Parquet, a folder per corpus."""
    docs.write.mode(mode).partitionBy(*[c for c in by if c in docs.columns]).parquet(path)


def append_index(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Documents with findings, of the folder layout (<id>/findings.json) and the flat one (<id>.json)."""
    t = spark.read.schema(LIBRARY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return t.filter(F.col("doc_id").isNotNull())


def findings(library: DataFrame) -> DataFrame:
    """A row per finding with its document's columns."""
    return library.select("doc_id", "url", "title", "published_at", F.explode("findings").alias("f")).select("doc_id", "url", "title", "published_at", "f.*")


def export_library(library: DataFrame, path: str) -> None:
    library.withColumn("findings_count", F.size(F.coalesce("findings", F.array()))).write.mode("overwrite").json(path)
