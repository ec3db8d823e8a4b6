"""Operators for preparing training text at scale: extraction, scoring, filtering, de-duplication, packing.

Nothing outside this subpackage imports it.
"""
