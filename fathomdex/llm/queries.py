"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, language_id, mixing, quality, secrets, sharding, simhash, toxicity, url_filter

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_secrets": secrets.op3_secrets,
    "op4_quality": quality.op4_quality,
    "op5_sharding": sharding.op5_sharding,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language_id": language_id.op10_language_id,
}

ORACLE_SQL = {"op2_url_filter": url_filter.SQL}
