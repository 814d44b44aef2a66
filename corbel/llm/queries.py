"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import q_byte_bpe, q_centroids, q_chat_format, q_decontaminate, q_html_text, q_line_dedup, q_mixing, q_near_dedup, q_quality_classifier, q_quality_rules, q_secrets, q_toxicity

QUERIES = {
    "op1_mixing": q_mixing.op1_mixing,
    "op2_decontaminate": q_decontaminate.op2_decontaminate,
    "op3_chat_format": q_chat_format.op3_chat_format,
    "op4_toxicity": q_toxicity.op4_toxicity,
    "op5_quality_classifier": q_quality_classifier.op5_quality_classifier,
    "op6_quality_rules": q_quality_rules.op6_quality_rules,
    "op7_near_dedup": q_near_dedup.op7_near_dedup,
    "op8_secrets": q_secrets.op8_secrets,
    "op9_html_text": q_html_text.op9_html_text,
    "op10_line_dedup": q_line_dedup.op10_line_dedup,
    "op11_centroid_clusters": q_centroids.op11_centroid_clusters,
    "op12_byte_bpe": q_byte_bpe.op12_byte_bpe,
}
ORACLE = {
    "op1_mixing": q_mixing.SQL,
    "op3_chat_format": q_chat_format.SQL,
    "op6_quality_rules": q_quality_rules.SQL,
    "op7_near_dedup": q_near_dedup.SQL,
    "op11_centroid_clusters": q_centroids.SQL,
}
