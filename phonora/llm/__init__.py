"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; the thin contract queries live in ``phonora.llm.queries``.
"""
