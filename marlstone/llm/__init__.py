"""Operators for building language-model training corpora.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; ``queries.py`` holds the registered ``opN_*`` queries.
"""
