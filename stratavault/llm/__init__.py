"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names, reads only the columns it names (extra columns, whatever they are
called, never clash) and returns a DataFrame.
"""
