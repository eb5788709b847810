"""Operators for large training corpora, one module each."""
