"""Each document's best frames against their SQL, on texts that a few bits or their length decide."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry


def both(spark, folder, name, texts):
    """Rows of a query and of its SQL on these texts."""
    con = duckdb.connect(config={"threads": 1})
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, 'en', 'a')", list(enumerate(texts)))
    con.execute(f"copy documents to '{folder}/documents.parquet' (format parquet)")
    columns = ["doc_id", "rank", "frame", "value"]
    got = entry.queries()[name](spark, str(folder)).select(*columns)
    return sorted(map(tuple, got.collect())), sorted(con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall())


def text(sentences):
    return " ".join(s.capitalize() + "." for s in sentences)


# Two frames of each have the same share, but not as sums of doubles.
EQUAL = (
    ["of and zz and and in", "of zz in of in the"],
    ["the in the", "in and zz in", "and and of the the of zz"],
    ["the the zz", "of zz the in the of", "in in in of of zz"],
)


@pytest.mark.parametrize("name", ["d42_top_frames", "e05_top_frames"])
def test_equal_shares_rank_as_in_sql(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, [text(s) for s in EQUAL] + [text(s[::-1]) for s in EQUAL])
    assert got == want and len({r[0] for r in got}) == 2 * len(EQUAL)


def test_sentences_are_read_to_their_end(spark, tmp_path):
    got, want = both(spark, tmp_path, "e05_top_frames", [text(["and " * 200 + "the " * 300]), text(["of"]) + " \n" + text(["zz " * 400 + "in"])])
    assert got == want == [(0, 1, "access", 0.6), (0, 2, "burden", 0.4), (1, 1, "change", 0.997512), (1, 2, "duty", 0.002488)]
