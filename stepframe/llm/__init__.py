"""Operators for large text collections; nothing outside this folder and `corpus_pipeline.py` imports them."""
