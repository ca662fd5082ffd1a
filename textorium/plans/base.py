"""How the test tables stand in for a corpus, in Spark and in SQL alike, and the register of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, frames
from ..sources.tables import spread, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Languages stand for corpora, sources for domains; dates run over two years by id."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") * 7 % 730).cast("int"))
    return spread(table(spark, d, "documents")).select(
        "doc_id", F.col("lang").alias("corpus"), F.col("source").alias("domain"), F.date_format(day, "yyyy-MM-dd").alias("published_at"), "text"
    )


DOCS = """docs as (select doc_id, lang as corpus, source as domain,
  strftime(date '2023-01-01' + cast(doc_id * 7 % 730 as integer), '%Y-%m-%d') as published_at, text from documents)"""


def chunks(spark: SparkSession, d: str, most_chars: int | None = 500) -> DataFrame:
    return chunking.sentence_chunks(documents(spark, d), "doc_id", "corpus", "domain", "published_at", most_chars=most_chars)


CHUNKS = (
    DOCS
    + r""", raw as (select doc_id, corpus, domain, published_at, list_filter(list_transform(list_transform(string_split(
  regexp_replace(text, '([.!?])(\s*\n|\s+[A-Z]|[A-Z]|\s*["”])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda x: substr(regexp_replace(x, '^\s+|\s+$', '', 'g'), 1, 500)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as cs from docs),
chunks as (select doc_id, corpus, domain, published_at, i - 1 as chunk_id, cs[i] as chunk from raw, unnest(range(1, len(cs) + 1)) u(i))"""
)


def scores(spark: SparkSession, d: str, most_chars: int | None = 500) -> DataFrame:
    return frames.lexical_scores(chunks(spark, d, most_chars), "doc_id", "corpus", "domain", "published_at", "chunk_id")


_LISTS = ", ".join("[" + ", ".join(f"'{w}'" for w in ws) + "]" for ws in frames.LEXICON.values())
_NAMES = ", ".join(f"'{f}'" for f in frames.LEXICON)
SCORES = (
    CHUNKS
    + rf""", toks as (select *, list_filter(string_split_regex(lower(chunk), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') as t,
  greatest(1, len(list_filter(string_split_regex(chunk, '\s+'), lambda t: t <> ''))) as w from chunks),
hits as (select *, list_transform([{_LISTS}], lambda ws: len(list_filter(t, lambda x: list_contains(ws, x)))) as h from toks),
scores as (select doc_id, corpus, domain, published_at, chunk_id, w, i - 1 as frame_idx, [{_NAMES}][i] as frame,
  case when list_sum(h) > 0 then cast(h[i] as double) / list_sum(h) else 0 end as p from hits, unnest(range(1, {len(frames.LEXICON) + 1})) u(i))"""
)

KEYS = ("doc_id", "corpus", "domain", "published_at")


def weighted(spark: SparkSession, d: str, threshold: float = 0.2) -> DataFrame:
    return frames.weighted_documents(scores(spark, d), KEYS, threshold)


WEIGHTED = (
    SCORES
    + """, w0 as (select doc_id, corpus, domain, published_at, frame_idx, frame, sum(case when p >= 0.2 then w * p else 0 end) / sum(w) as v,
  cast(sum(w) as double) as total_weight from scores group by all),
weighted as (select doc_id, corpus, domain, published_at, frame_idx, frame, case when sum(v) over d > 0 then v / sum(v) over d else v end as value,
  total_weight, sum(v) over d > 0 as any_value from w0 window d as (partition by doc_id))"""
)

#: The same over sentences of any length.
WHOLE_WEIGHTED = WEIGHTED.replace(r"substr(regexp_replace(x, '^\s+|\s+$', '', 'g'), 1, 500)", r"regexp_replace(x, '^\s+|\s+$', '', 'g')")


def occurring(spark: SparkSession, d: str, threshold: float = 0.2) -> DataFrame:
    return frames.occurring_documents(scores(spark, d), KEYS, threshold)


OCCURRING = (
    SCORES
    + """, o0 as (select doc_id, corpus, domain, published_at, frame_idx, frame, max(case when p >= 0.2 and p > 0 then 1.0 else 0.0 end)::double as value
  from scores group by all),
occurring as (select *, 1.0::double as total_weight, max(value) over (partition by doc_id) > 0 as any_value from o0)"""
)


def rounded(df: DataFrame, *columns: str, digits: int = 6, binary: bool = False) -> DataFrame:
    """binary: by the double's product with the power of ten, as DuckDB does, not by its decimal digits."""
    for c in columns:
        x = F.col(c).cast("double")
        df = df.withColumn(c, F.round(x * 10.0**digits) / 10.0**digits if binary else F.round(x, digits))
    return df
