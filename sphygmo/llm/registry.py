"""The training-data queries and their SQL."""

from __future__ import annotations

from sphygmo.llm import chat, embedding, fertility, licenses, media, merkle, mixing, near_dup, packing, periodic, secret_scan, sharding, toxicity

QUERIES = {
    "op1_embedding": embedding.op1_embedding,
    "op2_chat": chat.op2_chat,
    "op3_secrets": secret_scan.op3_secrets,
    "op4_licenses": licenses.op4_licenses,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_near_duplicates": near_dup.op6_near_duplicates,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_sharding": sharding.op9_sharding,
    "op10_media": media.op10_media,
    "op11_quality": fertility.op11_quality,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_merkle": merkle.op13_merkle,
}

#: The others are not SQL: their tests hold them against brute force or an exact round trip.
SQL = {
    "op1_embedding": embedding.OP1_SQL, "op2_chat": chat.OP2_SQL, "op3_secrets": secret_scan.OP3_SQL, "op4_licenses": licenses.OP4_SQL, "op6_near_duplicates": near_dup.OP6_SQL, "op7_mixing": mixing.OP7_SQL,
    "op12_periodic_runs": periodic.OP12_SQL, "op13_merkle": merkle.OP13_SQL,
}
