"""Queries of this folder, by name; `ORACLES` has DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from . import byte_pairs, decontaminate, hard_negatives, main_text, merkle_manifest, ngram_join, oracles, personal_data, quality, simhash, substring_dedup, token_counts, token_files, weighted_samples

QUERIES = {
    "op1_suffix_dedup": substring_dedup.op1_suffix_dedup,
    "op2_weighted_samples": weighted_samples.op2_weighted_samples,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_token_files": token_files.op4_token_files,
    "op5_byte_pairs": byte_pairs.op5_byte_pairs,
    "op6_main_text": main_text.op6_main_text,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality": quality.op8_quality,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_personal_data": personal_data.op10_personal_data,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}
ORACLES: dict[str, str] = {
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_merkle_manifest": oracles.MERKLE_MANIFEST,
    "op13_ngram_join": oracles.NGRAM_JOIN,
}
