"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries over the shared tables are in
``llm.queries``.
"""
