"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Each operator module holds the
general operator; ``queries`` holds the thin registered queries.
"""
