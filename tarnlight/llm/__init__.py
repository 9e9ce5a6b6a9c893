"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage.  Each module holds one
operator with a general interface; :mod:`tarnlight.llm.queries` derives the
registered digest queries from them.
"""
