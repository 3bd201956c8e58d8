"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, divergence, hard_negatives, lengths, media, near_dedup, quality, secrets, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_token_counts": lengths.query,
    "op2_secrets": secrets.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_minhash": near_dedup.query,
    "op5_toxicity": toxicity.query,
    "op6_decontaminate": decontaminate.query,
    "op7_bpe": bpe.query,
    "op8_media": media.query,
    "op9_chat": chat.query,
    "op10_quality": quality.query,
    "op11_divergence": divergence.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_sharding": sharding.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op4_minhash": near_dedup.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op9_chat": chat.SQL,
    "op11_divergence": divergence.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_sharding": sharding.SQL,
}
