"""Driver queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, decontaminate, hard_negatives, lm_score, minhash, mixing, near_dup, oracles, pii, quality, repair, sharding, suffix_dedup, url_filters

QUERIES = {
    "op1_url_filters": url_filters.query,
    "op2_pii": pii.query,
    "op3_mixing": mixing.query,
    "op4_lm_score": lm_score.query,
    "op5_chat": chat.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_quality": quality.query,
    "op8_near_dup": near_dup.query,
    "op9_decontaminate": decontaminate.query,
    "op10_sharding": sharding.query,
    "op11_minhash": minhash.query,
    "op12_repair": repair.query,
    "op13_hard_negatives": hard_negatives.query,
}

SQL: dict[str, str] = oracles.SQL
