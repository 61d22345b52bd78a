"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this package imports it.  ``registry`` lists
the queries, the other modules hold one operator each.
"""
