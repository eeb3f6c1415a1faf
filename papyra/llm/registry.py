"""Queries and oracles of this subpackage."""

from __future__ import annotations

from papyra.llm import chat, jaccard, langid, leaks, mixing, shards, tokens, topk, toxicity, urls

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_sharding": shards.op4_sharding,
    "op5_ngram_jaccard_join": jaccard.op5_ngram_jaccard_join,
    "op6_mixing_sources": mixing.op6_mixing_sources,
    "op7_language_id": langid.op7_language_id,
    "op8_benchmark_decontamination": leaks.op8_benchmark_decontamination,
    "op9_url_filters": urls.op9_url_filters,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES: dict[str, str] = {
    "op1_exact_topk": topk.oracle(),
    "op3_chat_formatting": chat.oracle(),
    "op5_ngram_jaccard_join": jaccard.oracle(),
    "op6_mixing_sources": mixing.oracle(),
    "op8_benchmark_decontamination": leaks.oracle(),
    "op9_url_filters": urls.oracle(),
}
