"""Registered queries and SQL of this subpackage."""

from __future__ import annotations

from fleetscope.llm import (bitslices, decontaminate, embeddings, extract, langid, mixing, pii, sharding, simhash, spelling,
                            substrings, toxicity, whitening)

QUERIES = {
    "op1_substring_dedup": substrings.op1_query,
    "op2_sharding": sharding.op2_query,
    "op3_html_extraction": extract.op3_query,
    "op4_language_id": langid.op4_query,
    "op5_embedding_dedup": embeddings.op5_query,
    "op6_mixing": mixing.op6_query,
    "op7_pii": pii.op7_query,
    "op8_simhash": simhash.op8_query,
    "op9_toxicity": toxicity.op9_query,
    "op10_decontaminate": decontaminate.op10_query,
    "op11_spelling_variants": spelling.op11_query,
    "op12_whitening": whitening.op12_query,
    "op13_topk": bitslices.op13_query,
}
#: the others learn, draw or search iteratively: tests check them against brute force
ORACLE = {
    "op1_substring_dedup": substrings.OP1_SQL,
    "op5_embedding_dedup": embeddings.OP5_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op13_topk": bitslices.OP13_SQL,
}
