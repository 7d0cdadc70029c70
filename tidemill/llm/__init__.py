"""Operators for preparing text collections for language-model training.

Nothing else in the library imports this subpackage.
"""
