"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from lexloom.llm import best_fit_packing, byte_bpe, chat_formatting, exact_top_k, hard_negatives, ngram_jaccard, pii, quality_rules, secret_scans, substring_dedup, suffix_array_dedup, toxicity, vector_codes

_MODULES = (ngram_jaccard, best_fit_packing, suffix_array_dedup, secret_scans, exact_top_k, quality_rules, pii, substring_dedup, byte_bpe, toxicity, chat_formatting, hard_negatives, vector_codes)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
