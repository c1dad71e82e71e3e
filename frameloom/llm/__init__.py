"""Operators for preparing training corpora; nothing else in the library imports this package.

Every operator takes and returns DataFrames. Rows are documents: a repeated row
is a document of its own, a null text is an empty one unless an operator says
otherwise, and columns that an operator does not need never clash with its own.
"""
