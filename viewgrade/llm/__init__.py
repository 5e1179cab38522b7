"""Training-data operators: deduplication, filtering, formatting, mixing and packing.

Nothing outside this subpackage imports it.  ``queries`` registers the operators.
"""
