"""The queries of this package and their SQL."""

from __future__ import annotations

from lamella.llm import bpe, html_text, line_dedup, lm_scoring, media_tiff, mih, mixing, ngram_join, secrets, toxicity

_MODULES = (ngram_join, media_tiff, mih, lm_scoring, toxicity, mixing, secrets, line_dedup, bpe, html_text)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
