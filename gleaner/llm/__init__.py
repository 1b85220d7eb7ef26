"""Operators for large-scale training-data preparation.

One module per operator; ``queries.py`` registers the queries that apply them
to the given tables and ``oracle.py`` holds the matching SQL.  Nothing else
in the library imports this subpackage.
"""
