"""Identifier expressions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "@@"


def global_id(corpus: Column, doc: Column) -> Column:
    return F.concat(corpus, F.lit(SEPARATOR), doc)


def passage_id(corpus: Column, doc: Column, chunk: Column) -> Column:
    return F.concat(global_id(corpus, doc), F.lit(":chunk"), F.lpad(chunk.cast("string"), 3, "0"))


def split_global(x: Column) -> tuple[Column, Column]:
    """(corpus or null, document) of a global or local id."""
    corpus = F.substring_index(x, SEPARATOR, 1)
    rest = F.substring(x, F.length(corpus) + len(SEPARATOR) + 1, F.length(x))
    has = x.contains(SEPARATOR)
    return F.when(has, corpus), F.when(has, rest).otherwise(x)


def chunk_id(doc: Column, chunk: Column) -> Column:
    return F.concat(doc, F.lit("_chunk_"), chunk)


def parse_chunk_id(x: Column) -> tuple[Column, Column]:
    """(document, number); nulls unless there are exactly two parts and the second is a whole number."""
    parts = F.split(x, "_chunk_")
    number = F.try_element_at(parts, F.lit(2)).try_cast("int")
    good = (F.size(parts) == 2) & number.isNotNull()
    return F.when(good, parts[0]), F.when(good, number)


def finding_document(finding: Column) -> Column:
    return F.split_part(finding, F.lit("_"), F.lit(1))


def document_id(url: Column) -> Column:
    """Six digits from the URL's hash, the same in every process."""
    return F.lpad(F.pmod(F.xxhash64(url), F.lit(1_000_000)).cast("string"), 6, "0")


def finding_id(doc: Column, n: Column) -> Column:
    return F.concat(doc, F.lit("_"), F.lpad(n.cast("string"), 3, "0"))


def spec_key(*parts: Column) -> Column:
    """Twelve hex digits for a named set of parameters."""
    return F.substring(F.sha1(F.to_json(F.struct(*parts))), 1, 12)
