"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from lexgrove.llm import chat, clustering, fingerprint, language, line_dedup, online_packing, packing, repair, sentencepieces, sharding, simhash, topk, toxicity


def queries() -> dict:
    return {
        "op1_sentencepiece": sentencepieces.query,
        "op2_chat_format": chat.query,
        "op3_simhash_near_dedup": simhash.query,
        "op4_exact_top_k": topk.query,
        "op5_best_fit_packing": packing.query,
        "op6_fingerprints": fingerprint.query,
        "op7_sharding": sharding.query,
        "op8_line_dedup": line_dedup.query,
        "op9_language_id": language.query,
        "op10_toxicity": toxicity.query,
        "op11_online_packing": online_packing.query,
        "op12_centroid_clustering": clustering.query,
        "op13_conversation_repair": repair.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat.ORACLE,
        "op4_exact_top_k": topk.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op12_centroid_clustering": clustering.ORACLE,
    }
