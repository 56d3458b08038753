"""Operators for large text corpora: packing, deduplication, scoring, sketches and mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
