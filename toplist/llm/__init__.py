"""Operators for preparing language-model training corpora at scale.

One module per operator; :mod:`toplist.llm.queries` registers a query for each
over the given tables.  Every operator takes a DataFrame and returns one; none
needs more of the input's columns than the ones it is told to read.
"""
