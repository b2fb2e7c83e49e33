"""Operators for training-data pipelines: packing, extraction, scans, dedup, classification.

Nothing outside this package imports it. Each module holds one operator with its own
general interface; :mod:`siltstone.llm.queries` applies them to whole tables.
"""
