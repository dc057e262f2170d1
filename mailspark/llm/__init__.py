"""Operators for training-data preparation, one module per operator.

Nothing outside this package imports it; ``registry`` exposes the queries.
"""
