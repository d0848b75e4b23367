"""All queries over the shared tables, and the SQL that gives the same rows."""

from __future__ import annotations

from . import crawl_queries, eval_queries, find_queries, format_queries, page_queries, payload_queries, question_queries, ranked_queries, text_queries, url_queries  # noqa: F401  (each registers its queries)
from .base import QUERIES, SQL
from .page_queries import page_extract_markdown  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
