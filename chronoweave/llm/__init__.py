"""Operators for large training-data pipelines.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
Queries and their SQL are in :mod:`chronoweave.llm.queries`.
"""
