"""The subpackage's queries and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline

from . import exact_dedup, html_text, line_quality, near_dedup, packing, pii, quality_knn, secrets, source_mix, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pii": pii.op1_pii,
    "op2_secrets": secrets.op2_secrets,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality_knn": quality_knn.op4_quality_knn,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_html_text": html_text.op8_html_text,
    "op9_line_quality": line_quality.op9_line_quality,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}
#: The others return spans or ids that SQL can't derive; tests/llm holds them against brute force.
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE_OP3,
    "op6_source_mix": source_mix.ORACLE_OP6,
    "op7_url_filter": url_filter.ORACLE_OP7,
    "op9_line_quality": line_quality.ORACLE_OP9,
    "op10_near_dedup": near_dedup.ORACLE_OP10,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
