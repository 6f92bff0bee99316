"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every operator takes and returns DataFrames; the thin
``opN_*`` functions in :mod:`docspark.llm.queries` apply one operator each to the driver's tables.
"""
