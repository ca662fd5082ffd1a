"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textorium.llm import decontamination, language_id, line_dedup, mixing, near_texts
from textorium.llm.common import table, written

#: A document whose best language has less than this pooled probability isn't in one language.
LEAST_SCORE = 0.5
#: Near copies have so many hundredths of their shingles, of so many words, in common (Jaccard).
SIMILAR, SHINGLE = 80, 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages."""
    return language_id.speaking(docs, language_id.learn(docs), LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of lines; documents of which no word is left go."""
    cut = line_dedup.dedup(docs, whole=True)
    left = (F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.filter(left).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_texts.keep_one(docs, shingle=SHINGLE, similar=SIMILAR).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their target weights: the documents taken, with the words taken, their shard and spans."""
    return mixing.mixed(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("sources", sources)]

#: The network and the hashes aren't in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
