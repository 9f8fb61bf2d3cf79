"""Operators of a training-data pipeline over large text tables.

One module per operator, ``queries`` with the registered queries and their SQL.
Nothing else in the library imports this subpackage.
"""
