"""Operators for building training data: text, vectors, pages and archives.

Nothing outside this subpackage imports it.
"""
