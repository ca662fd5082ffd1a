"""Chunkers and extractors as table functions, for LATERAL joins in SQL; their columns follow from their constant arguments.

    register(spark)
    select d.doc_id, c.* from documents d, lateral text_chunks(d.text, 'sentences') c
    select d.doc_id, s.* from documents d, lateral text_spans(d.text) s

More chunkers come with `register(spark, {"name": function of a text})`. Cases: a null or blank text has no rows; an unknown name is an error
when the query is analysed, before anything runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.actors import _spans
from ..operators.chunking import BOUNDARY, MARK

_END = re.compile(BOUNDARY, re.ASCII)
_BLANK = " \t\n\x0b\x0c\r"


def sentences(text: str, most_chars: int = 500) -> list[str]:
    """As `chunking.sentences`: trimmed sentences of at most so many characters."""
    parts = (x.strip(_BLANK)[:most_chars].strip(_BLANK) for x in _END.sub(rf"\1{MARK}", text).split(MARK))
    return [x for x in parts if x]


def paragraphs(text: str) -> list[str]:
    return [x for x in (p.strip(_BLANK) for p in re.split(r"\n[ \t\x0b\x0c\r]*\n", text)) if x]


CHUNKERS: dict[str, Callable[[str], Iterable[str]]] = {"sentences": sentences, "paragraphs": paragraphs}


def _text(argument: AnalyzeArgument) -> None:
    if not isinstance(argument.dataType, StringType):
        raise ValueError("the first argument must be a string")


def chunker_function(chunkers: dict[str, Callable[[str], Iterable[str]]]):
    """text_chunks(text, name): (chunk_id, chunk), with `chunker` too if no name is given, by all of them."""

    class Chunks:
        @staticmethod
        def analyze(text: AnalyzeArgument, name: AnalyzeArgument | None = None) -> AnalyzeResult:
            _text(text)
            if name is not None and (not name.isConstantExpression or name.value not in chunkers):
                raise ValueError(f"the chunker must be one of {', '.join(sorted(chunkers))}")
            own = StructType().add("chunk_id", IntegerType()).add("chunk", StringType())
            return AnalyzeResult(own if name is not None else own.add("chunker", StringType()))

        def eval(self, text: str, name: str | None = None):
            for k in [name] if name is not None else sorted(chunkers):
                for i, c in enumerate(chunkers[k](text or "")):
                    yield (i, c) if name is not None else (i, c, k)

    return udtf(Chunks, useArrow=True)


class Spans:
    """text_spans(text, kind): (kind, start, end, span, confidence) of mentions and claims, all or of one kind."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(text)
        if kind is not None and not kind.isConstantExpression:
            raise ValueError("the kind must be constant")
        return AnalyzeResult(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("span", StringType()).add("confidence", DoubleType()))

    def eval(self, text: str, kind: str | None = None):
        for s in _spans(text or ""):
            if kind is None or s[0] == kind:
                yield s


def register(spark: SparkSession, chunkers: dict[str, Callable[[str], Iterable[str]]] | None = None) -> None:
    """Makes text_chunks and text_spans known to the session's SQL."""
    spark.udtf.register("text_chunks", chunker_function(CHUNKERS | (chunkers or {})))
    spark.udtf.register("text_spans", udtf(Spans, useArrow=True))
