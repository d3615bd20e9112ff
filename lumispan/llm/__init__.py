"""Operators for preparing training data: thirteen numbered operators and their queries.

Nothing else in the library imports this subpackage.
"""
