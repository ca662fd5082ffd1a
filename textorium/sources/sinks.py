"""Results to files, by Spark's writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(rows: DataFrame, path: str, order: Sequence = ()) -> None:
    """A CSV table with a header, as one file: for report tables, whose rows are bounded by their keys."""
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def named(tables: dict[str, DataFrame], path: str) -> None:
    """Each named table as Parquet below path."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def chunk_store(chunks: DataFrame, path: str, key: str) -> None:
    """Chunks or vectors of one specification; only its own partition is replaced."""
    chunks.withColumn("spec", F.lit(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("spec").parquet(path)


def html_table(rows: DataFrame, title: str, limit: int = 200) -> str:
    """A report table at the edge: its first rows as HTML."""
    return f"<h1>{title}</h1>{rows.limit(limit).toPandas().to_html(index=False)}"
