"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from momentlake.llm import alignment, embedding_dedup, graph_search, html_text, language_id, minhash_dedup, mixing, pieces, quality, token_counts, token_files, topk, whitening

MODULES = (token_counts, quality, html_text, topk, embedding_dedup, language_id, minhash_dedup, token_files, mixing, pieces, graph_search, alignment, whitening)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in getattr(m, "ORACLE", {}).items()}
