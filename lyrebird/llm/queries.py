"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lyrebird.llm import ann, bpe, chat, importance, infill, jaccard, lm, mixing, outliers, simhash, substrings, token_cache, urls

QUERIES = {
    "op1_simhash_dedup": simhash.op1_simhash_dedup,
    "op2_quality_outliers": outliers.op2_quality_outliers,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_token_counts": token_cache.op5_token_counts,
    "op6_url_filter": urls.op6_url_filter,
    "op7_lm_scores": lm.op7_lm_scores,
    "op8_chat_format": chat.op8_chat_format,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_jaccard_join": jaccard.op13_jaccard_join,
}
SQL = {"op3_mix_sources": mixing.OP3_SQL, "op6_url_filter": urls.OP6_SQL, "op8_chat_format": chat.OP8_SQL, "op10_substring_dedup": substrings.OP10_SQL, "op11_fill_in_middle": infill.OP11_SQL}
