"""Operators for large-scale training-data preparation.

Each module holds one operator with a general interface; ``queries`` registers
the thin ``opN_*`` queries that apply them to whole tables.  Nothing outside
this subpackage imports it.
"""
