"""Imports every module that registers a query."""

from auxoline.llm import chat_format, decontaminate, exact_dedup, filter_audit, html_extract, mixture, near_dedup, quality, suffix_dedup, token_counts, url_templates, warc, whitening  # noqa: F401
from auxoline.llm.registry import ORACLES, QUERIES  # noqa: F401
