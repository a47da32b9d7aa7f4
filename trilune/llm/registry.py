"""Queries of this subpackage by name, and their DuckDB SQL where SQL expresses them."""

from trilune.llm import centroids, contamination, filter_audit, jaccard_join, language_id, lm_scoring, mixing, nearest, outliers, substring_dedup, token_counts, toxicity, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_toxicity": toxicity.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_language_id": language_id.query,
    "op5_token_counts": token_counts.query,
    "op6_mixing": mixing.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_lm_scoring": lm_scoring.query,
    "op9_nearest": nearest.query,
    "op10_contamination": contamination.query,
    "op11_filter_audit": filter_audit.query,
    "op12_outliers": outliers.query,
    "op13_centroids": centroids.query,
}

SQL = {
    "op1_warc": warc.SQL,
    "op6_mixing": mixing.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_centroids": centroids.SQL,
}
