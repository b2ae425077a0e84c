"""Operators of a training-data pipeline over raw text tables.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin queries that bind them to the test tables are in
:mod:`lamella.llm.queries`.
"""
