"""The registered queries of this package and their SQL."""

from __future__ import annotations

from lodestone.llm import bpe, decontamination, exact_dedup, html_text, jaccard_join, language_id, lm_scoring, periodic_runs, pii, source_audit, substring_dedup, token_counts, url_filters

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_language_id": language_id.op3_language_id,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_pii": pii.op10_pii,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_url_filters": url_filters.op12_url_filters,
    "op13_source_audit": source_audit.op13_source_audit,
}
SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op11_periodic_runs": periodic_runs.OP11_SQL,
    "op12_url_filters": url_filters.OP12_SQL,
    "op13_source_audit": source_audit.OP13_SQL,
}
