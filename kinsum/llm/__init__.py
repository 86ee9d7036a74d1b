"""Operators of a training-data pipeline over a ``documents`` table.

Every operator takes and returns DataFrames; :mod:`kinsum.llm.registry` turns
them into the registered ``opN_*`` queries.  Nothing else in the library
imports this subpackage.
"""
