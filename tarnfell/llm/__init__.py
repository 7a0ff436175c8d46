"""Training-data operators: scoring, tokenising, search, mixing, filtering, de-duplication.

Nothing outside this subpackage imports it.
"""
