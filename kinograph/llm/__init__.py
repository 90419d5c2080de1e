"""Operators for building training corpora: ten independent modules plus their registered queries.

Nothing outside this package imports it.
"""
