"""Queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from placeloom.llm import bpe, decontamination, fingerprints, html, jaccard, langid, lm, pii, toxicity, warc

QUERIES = {
    "op9_html_extraction": html.op9_html_extraction,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op4_language_id": langid.op4_language_id,
    "op5_warc": warc.op5_warc,
    "op8_pii": pii.op8_pii,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op1_toxicity": toxicity.op1_toxicity,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
    "op10_decontamination": decontamination.op10_decontamination,
}
ORACLES = {
    "op5_warc": warc.ORACLE_SQL,
    "op6_ngram_jaccard_join": jaccard.ORACLE_SQL,
    "op10_decontamination": decontamination.ORACLE_SQL,
}
