"""Operators for preparing language-model training data, one module each.

Nothing outside this package imports it; ``queries.py`` registers the
``opN_<name>`` queries and their SQL.
"""
