"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from corpusloom.llm import alignment, bpe, chat, fim, language, media, ngram_join, packing, quality, recompress, sharding, unigram, urls

MODULES = (sharding, chat, ngram_join, unigram, packing, quality, bpe, urls, media, recompress, fim, alignment, language)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
