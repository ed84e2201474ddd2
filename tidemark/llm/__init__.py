"""Operators for preparing training data: language identification, language-model
scoring, personal data, vector search, token files, packing, exact top-k search,
similarity joins, encoding and licence scans.

Nothing else in the library imports this folder.
"""
