"""Operators for large training corpora: language id, secrets, PII, mixing, near-duplicates, packing, media, quality, WARC.

Nothing outside this subpackage (and corpus_pipeline.py at the top) imports it.
"""
