"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from prospectrum.llm import bpe, decontaminate, fm_dedup, hnsw, language, media, packing, quality, ranked_search, simhash, spelling, suffix_dedup, token_files

MODULES = (bpe, decontaminate, fm_dedup, hnsw, language, media, packing, quality, ranked_search, simhash, spelling, suffix_dedup, token_files)


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in getattr(m, "ORACLES", {}).items()}
