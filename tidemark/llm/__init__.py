"""Operators for training-data pipelines: sharding, chat formatting, toxicity, search, tokens, dedup, extraction.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in ``__spark_entry__.py`` uses it.
"""
