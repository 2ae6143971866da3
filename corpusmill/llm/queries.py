"""The queries of this subpackage and, where SQL can express one, its DuckDB form."""

from . import lm_scores, mixing, pieces, quality_rules, simhash, substring, token_files, topk, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_token_output": token_files.op4_token_output,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_top_k": topk.op6_top_k,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_lm_scores": lm_scores.op9_lm_scores,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLES = {"op1_url_filter": url_filter.ORACLE, "op6_top_k": topk.ORACLE, "op10_quality_rules": quality_rules.ORACLE}
