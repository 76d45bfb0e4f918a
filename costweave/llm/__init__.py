"""Operators of a training-data pipeline over document, embedding and conversation tables.

Nothing outside this package imports it. `queries` holds the registered queries.
"""
