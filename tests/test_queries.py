"""Every query that has SQL against it, on the smallest tables; the others for a stable schema."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from textorium.plans import registry
from tools.compare import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    said, ok = compare(spark, FOLDER, name, registry.SQL.get(name))
    assert ok, said


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["corpus", "period_id", "frame", "value", "document_count"] and df.count() > 0
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(entry.queries())
