"""Training-data operators: toxicity, fingerprints, BPE, language id, WARC, Jaccard join,
language-model scoring, PII surrogates, main-text extraction and decontamination.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
