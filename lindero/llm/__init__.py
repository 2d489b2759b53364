"""Operators for preparing texts of language-model training data.

Nothing outside this subpackage imports it.
"""
