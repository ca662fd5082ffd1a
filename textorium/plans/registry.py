"""The reference operators' queries by name, and the SQL that each is held against."""

from __future__ import annotations

from . import analytics_queries, frame_queries, store_queries, text_queries  # noqa: F401
from .base import QUERIES, SQL

flagship = frame_queries.flagship_monthly_frames

__all__ = ["QUERIES", "SQL", "flagship"]
