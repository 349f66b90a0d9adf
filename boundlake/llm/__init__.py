"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` registers the thin ``opN_*``
queries that derive their digest columns from the operators' outputs.
"""
