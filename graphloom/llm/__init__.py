"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; each module states its own rules for nulls, empty and very
long texts, ties, repeated rows, empty tables and clashing column names.
"""
