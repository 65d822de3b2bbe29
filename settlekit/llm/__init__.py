"""Operators for preparing training data, one module each; `queries.py` registers them.

Nothing else in the library imports this subpackage.
"""
