"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import forest, licenses, lm, mainhtml, mixing, near, phrases, pieces, quality, substring, suffixes, toxicity, whitening

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op4_license_names": licenses.op4_license_names,
    "op5_nearest_neighbours": forest.op5_nearest_neighbours,
    "op6_minhash_near_dedup": near.op6_minhash_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_html_extraction": mainhtml.op9_html_extraction,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_whitening": whitening.op11_whitening,
    "op12_suffix_array_dedup": suffixes.op12_suffix_array_dedup,
    "op13_phrase_mining": phrases.op13_phrase_mining,
}
ORACLE_SQL = {
    "op2_quality_rules": quality.ORACLE_SQL,
    "op3_substring_dedup": substring.ORACLE_SQL,
    "op4_license_scan": licenses.ORACLE_SQL,
    "op6_minhash_near_dedup": near.ORACLE_SQL,
    "op12_suffix_array_dedup": suffixes.ORACLE_SQL,
    "op13_phrase_mining": phrases.ORACLE_SQL,
}
