"""All registered queries of the library proper."""

from . import book_queries, catalog_queries, extra_queries, gate_queries, language_queries, layout_queries, more_queries, page_queries, report_queries, review_queries, text_queries, title_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
