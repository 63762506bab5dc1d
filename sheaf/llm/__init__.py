"""Operators of a training-data pipeline over tables of documents, pages and benchmark items.

Nothing outside this subpackage imports it.
"""
