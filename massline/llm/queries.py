"""The queries of this package by name, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import embeddings, fingerprint, language, mix, near_dup, packing, quality, secrets, substrings, toxicity


def queries() -> dict:
    return {"op1_fingerprint": fingerprint.op1_fingerprint, "op2_embeddings": embeddings.op2_embeddings, "op3_language": language.op3_language, "op4_packing": packing.op4_packing, "op5_toxicity": toxicity.op5_toxicity, "op6_substrings": substrings.op6_substrings, "op7_secrets": secrets.op7_secrets, "op8_quality": quality.op8_quality, "op9_mix": mix.op9_mix, "op10_minhash": near_dup.op10_minhash}


def oracle_sql() -> dict:
    return {"op9_mix": mix.oracle()}
