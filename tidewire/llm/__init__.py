"""Operators for large text corpora: archives, scores, mixes, packing, search and near-duplicates.

Each operator takes DataFrames and column names, uses only the columns it is
told of, and leaves others alone. Nothing else in the library imports this package.
"""
