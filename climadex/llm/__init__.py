"""Training-data operators: deduplication, tokens, packing, scoring, scans.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; documents are rows with at least ``doc_id`` and ``text``.
"""
