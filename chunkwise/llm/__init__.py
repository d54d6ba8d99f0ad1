"""Operators for preparing text corpora for language-model training.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
