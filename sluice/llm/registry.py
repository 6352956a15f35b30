"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sluice.llm import fingerprint, html_text, jaccard_join, licenses, line_dedup, mixing, pieces, pii, quality, suffix_tree

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_lm_score": suffix_tree.op2_lm_score,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_mixing": mixing.op5_mixing,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_ngram_jaccard": jaccard_join.op9_ngram_jaccard,
    "op10_html_text": html_text.op10_html_text,
}
#: The learned verdict of op3 is not SQL; its query is tested against brute force.
ORACLES = {
    "op1_pii": pii.OP1_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_fingerprint": fingerprint.OP8_SQL,
    "op9_ngram_jaccard": jaccard_join.OP9_SQL,
}
