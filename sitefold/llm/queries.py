"""Registered queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from sitefold.llm import (
    decontaminate,
    exact_dedup,
    html_extract,
    jaccard_join,
    language_id,
    merkle,
    packing,
    periodic,
    quality,
    secret_scan,
    sharding,
    suffix_dedup,
    toxicity,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality": quality.op2_quality,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_packing": packing.op4_packing,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_sharding": sharding.op12_sharding,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE_SQL = {
    "op3_secret_scan": secret_scan.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_sharding": sharding.OP12_SQL,
    "op13_periodic_runs": periodic.OP13_SQL,
}
